"""Estimators (K1-K18): closed-form models as aggregates + expressions, the rest via Spark ML.

Closed-form models (Gaussian naive Bayes, one-feature least squares) fit with
one aggregate whose result is k x p numbers, and score with pure column
expressions (map-side, whole-stage codegen).  Iterative models use Spark ML
estimators on a cached, vector-assembled training frame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VAR_SMOOTHING = 1e-9


@dataclass
class GaussianNB:
    classes: list[str]
    features: list[str]
    prior: dict[str, float]
    theta: dict[str, list[float]]
    var: dict[str, list[float]]

    def jll(self, c: str) -> Column:
        """Joint log-likelihood of class c as a column expression."""
        th, va = self.theta[c], self.var[c]
        expr = F.lit(math.log(self.prior[c]) - 0.5 * sum(math.log(2 * math.pi * v) for v in va))
        for f, m, v in zip(self.features, th, va):
            d = F.col(f"`{f}`").cast("double") - F.lit(m)
            expr = expr - F.lit(0.5) * d * d / F.lit(v)
        return expr


def fit_gaussian_nb(df: DataFrame, features: list[str], label: str) -> GaussianNB:
    """Per-class mean / population variance + 1e-9 * max feature variance."""
    lab = F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("null"))
    x = [F.col(f"`{f}`").cast("double") for f in features]
    rows = df.groupBy(lab.alias("c")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)],
    ).collect()
    total = sum(r["n"] for r in rows)
    # overall population variance from the per-class moments (no second pass)
    overall = []
    for i in range(len(features)):
        mu = sum(r["n"] * r[f"m{i}"] for r in rows) / total
        overall.append(sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mu) ** 2) for r in rows) / total)
    eps = VAR_SMOOTHING * max(overall)
    classes = sorted(r["c"] for r in rows)
    by = {r["c"]: r for r in rows}
    return GaussianNB(
        classes=classes, features=list(features),
        prior={c: by[c]["n"] / total for c in classes},
        theta={c: [by[c][f"m{i}"] for i in range(len(features))] for c in classes},
        var={c: [by[c][f"v{i}"] + eps for i in range(len(features))] for c in classes},
    )


def predict_gaussian_nb(df: DataFrame, model: GaussianNB, prefix: str = "p_", digits: int | None = 9) -> DataFrame:
    """Adds ``p_<class>`` probabilities (softmax of jll) and ``predicted``."""
    jl = [model.jll(c) for c in model.classes]
    tmp = df.select("*", *[e.alias(f"_j{i}") for i, e in enumerate(jl)])
    cols = [F.col(f"_j{i}") for i in range(len(jl))]
    mx = F.greatest(*cols) if len(cols) > 1 else cols[0]
    tmp = tmp.withColumn("_mx", mx)
    den = sum(F.exp(c - F.col("_mx")) for c in cols)
    probs = []
    for i, c in enumerate(model.classes):
        p = F.exp(F.col(f"_j{i}") - F.col("_mx")) / den
        probs.append((F.round(p, digits) if digits is not None else p).alias(f"{prefix}{c}"))
    # argmax, first class wins ties
    pred = F.lit(model.classes[-1])
    for i in reversed(range(len(model.classes) - 1)):
        better = F.lit(True)
        for j in range(len(model.classes)):
            if j != i:
                better = better & ((F.col(f"_j{i}") > F.col(f"_j{j}")) if j < i else (F.col(f"_j{i}") >= F.col(f"_j{j}")))
        pred = F.when(better, F.lit(model.classes[i])).otherwise(pred)
    out = tmp.select(*df.columns, *probs, pred.alias("predicted"))
    return out


@dataclass
class LinearFit:
    slope: float
    intercept: float


def fit_simple_linear(df: DataFrame, x: str, y: str) -> LinearFit:
    """K13 for one feature: least squares via regr_slope / regr_intercept."""
    r = df.agg(F.regr_slope(F.col(y), F.col(x)).alias("b"), F.regr_intercept(F.col(y), F.col(x)).alias("a")).collect()[0]
    return LinearFit(float(r["b"]), float(r["a"]))
