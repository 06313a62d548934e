"""Validation statistics.

Every statistic is reduced to a small aggregate first: a cross-tab per
feature (Cramér's V), a p x p Gram matrix (VIF), k x k confusion cells
(bootstrap, subgroup metrics), two conditional counts per model pair
(McNemar).  Only those reach the driver or a pandas batch.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

EPS_F1 = 1e-9
STABLE_DELTA = 0.08
SENSITIVITY_RANGE = 0.02


# ------------------------------------------------------------------ Cramér's V


def equal_width_edges(lo: float, hi: float, bins: int = 10) -> list[float]:
    """Interior edges of an equal-width binning (right-closed, as pandas.cut)."""
    if hi == lo:
        return []
    edges = np.linspace(lo, hi, bins + 1)
    return [float(e) for e in edges[1:-1]]


def bin_expr(c: Column, edges: list[float]) -> Column:
    """Bin index = number of interior edges strictly below x; missing -> 'nan'."""
    idx = sum(F.when(c > F.lit(e), 1).otherwise(0) for e in edges) if edges else F.lit(0)
    return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(idx.cast("string"))


def cramers_v(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Bias-corrected Cramér's V of each feature vs target: (feature, cramers_v)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if isinstance(types[c], NumericType)]
    rng = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in numeric],
                 *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in numeric]).collect()[0] if numeric else {}
    items = []
    for c in features:
        if c in numeric:
            v = bin_expr(F.col(c).cast("double"), equal_width_edges(rng[f"lo_{c}"], rng[f"hi_{c}"], bins))
        else:
            v = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        items.append(F.struct(F.lit(c).alias("feature"), v.alias("value")))
    long = df.select(F.col(target).cast("string").alias("_y"), F.explode(F.array(*items)).alias("x")).where(
        F.col("_y").isNotNull()
    )
    ct = long.groupBy("x.feature", "x.value", "_y").agg(F.count(F.lit(1)).alias("o"))
    rows_t = ct.groupBy("feature", "value").agg(F.sum("o").alias("R"))
    cols_t = ct.groupBy("feature", "_y").agg(F.sum("o").alias("C"))
    tot_t = ct.groupBy("feature").agg(F.sum("o").alias("n"))  # Spark broadcasts these where their size allows
    ct = ct.join(rows_t, ["feature", "value"]).join(cols_t, ["feature", "_y"]).join(tot_t, "feature")
    per = ct.groupBy("feature").agg(
        (F.first("n") * (F.sum(F.col("o") * F.col("o") / (F.col("R") * F.col("C"))) - 1)).alias("chi2"),
        F.first("n").alias("n"),
        F.count_distinct("value").alias("r"),
        F.count_distinct("_y").alias("c"),
    )
    n, r, c = F.col("n"), F.col("r"), F.col("c")
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / n - (r - 1) * (c - 1) / (n - 1))
    r2 = r - (r - 1) * (r - 1) / (n - 1)
    c2 = c - (c - 1) * (c - 1) / (n - 1)
    denom = F.least(r2 - 1, c2 - 1)
    v = F.when(denom > 0, F.sqrt(phi2 / denom)).otherwise(0.0)
    return per.select("feature", F.round(v, 4).alias("cramers_v"))


# ------------------------------------------------------------------ VIF


GRAM_SLOTS = 32  # tasks that merge the sums of the input tasks before the last one


def gram_matrix(df: DataFrame, columns: list[str], intercept: bool = False) -> np.ndarray:
    """X'X; optional intercept column first. Missing values count as 0 in the products.

    Every task sums its own p x p products block by block; the sums are merged
    in a tree of two levels, each task holding one p x p matrix. One job,
    whatever the number of columns.
    """
    p = len(columns) + int(intercept)

    def products(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        total = np.zeros((p, p))
        for pdf in batches:
            known = np.array(pdf["_known"].tolist(), bool).reshape(len(pdf), len(columns))
            x = np.where(known, pdf.drop(columns="_known").to_numpy(float), 0.0)
            if intercept:
                x = np.column_stack([np.ones(len(x)), x])
            total += x.T @ x
        slot = TaskContext.get().partitionId() % GRAM_SLOTS
        yield pd.DataFrame({"slot": slot, "i": range(p), "sums": list(total)})

    def merged(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros((p, p))
        for pdf in batches:
            for i, sums in zip(pdf["i"], pdf["sums"]):
                total[i] += sums
        yield pd.DataFrame({"slot": 0, "i": range(p), "sums": list(total)})

    schema = "slot int, i int, sums array<double>"
    known = F.array(*[F.col(f"`{c}`").isNotNull() for c in columns]).alias("_known")
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)], known)
    sums = rows.mapInPandas(products, schema).repartition(GRAM_SLOTS, "slot").mapInPandas(merged, schema)
    out = np.zeros((p, p))
    for r in sums.coalesce(1).mapInPandas(merged, schema).collect():
        out[r["i"]] = r["sums"]
    return out


def vif(df: DataFrame, columns: list[str], intercept: bool = False) -> list[tuple[str, float]]:
    """VIF_i = G_ii * (G^-1)_ii (no intercept, as the reference calls it; quirk Q16)."""
    g = gram_matrix(df, columns, intercept)
    if intercept:
        # centred R^2: VIF = 1 / (1 - R^2) from the covariance matrix
        mean = g[0, 1:] / g[0, 0]
        g = g[1:, 1:] / g[0, 0] - np.outer(mean, mean)
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    values, vectors = np.linalg.eigh(g / np.outer(scale, scale))
    null = vectors[:, values <= 1e-12 * max(values.max(), 1.0)]
    if null.shape[1]:
        # a column that takes part in an exact dependence has no finite VIF
        tied = (np.abs(null) > 1e-6).any(axis=1)
        inv = np.linalg.pinv(g)
        return [(c, float("inf") if tied[i] else float(g[i, i] * inv[i, i])) for i, c in enumerate(columns)]
    inv = np.linalg.inv(g)
    return [(c, float(g[i, i] * inv[i, i])) for i, c in enumerate(columns)]


# ------------------------------------------------------------------ subgroup metrics


def subgroup_metrics(df: DataFrame, subgroup: str, actual: str, predicted: str, chosen_class: str | None = None,
                     min_support: int = 30) -> DataFrame:
    """Per subgroup: macro-F1, balanced accuracy, chosen-class recall, support (support >= min)."""
    lab = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    cells = df.groupBy(F.col(subgroup).alias("subgroup"), lab(actual).alias("a"), lab(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    tp = cells.where("a = p").groupBy("subgroup", F.col("a").alias("class")).agg(F.sum("n").alias("tp"))
    sup = cells.groupBy("subgroup", F.col("a").alias("class")).agg(F.sum("n").alias("support"))
    prd = cells.groupBy("subgroup", F.col("p").alias("class")).agg(F.sum("n").alias("pred_n"))
    pc = sup.join(prd, ["subgroup", "class"], "full_outer").join(tp, ["subgroup", "class"], "left").fillna(
        0, ["tp", "support", "pred_n"]
    )
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    pc = pc.select("subgroup", "class", "tp", "support", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    agg = pc.groupBy("subgroup").agg(
        F.avg(f1).alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.max(F.when(F.col("class") == F.lit(chosen_class), F.col("recall"))) if chosen_class is not None
         else F.lit(None).cast("double")).alias("class_recall"),
        F.sum("support").alias("support"),
    )
    return agg.where(F.col("support") >= min_support)


# ------------------------------------------------------------------ McNemar


def mcnemar(pred: DataFrame, key: str, actual: str, models: list[str]) -> DataFrame:
    """All unordered model pairs: b = only m1 right, c = only m2 right; continuity-corrected chi2.

    ``pred`` is wide: one predicted-label column per model (a join of the
    per-model prediction tables on the key).  One aggregate pass gives all
    pair counts; pairs with b + c = 0 are skipped.
    """
    a = F.col(actual).cast("string")
    rows = []
    aggs = []
    for i, m1 in enumerate(models):
        for m2 in models[i + 1:]:
            c1 = F.col(m1).cast("string") == a
            c2 = F.col(m2).cast("string") == a
            aggs += [F.count_if(c1 & ~c2).alias(f"b|{m1}|{m2}"), F.count_if(~c1 & c2).alias(f"c|{m1}|{m2}")]
            rows.append((m1, m2))
    one = pred.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(m1).alias("m1"), F.lit(m2).alias("m2"), F.col(f"`b|{m1}|{m2}`").alias("b"), F.col(f"`c|{m1}|{m2}`").alias("c"))
        for m1, m2 in rows
    ])
    t = one.select(F.explode(items).alias("x")).select("x.*").where(F.col("b") + F.col("c") > 0)
    bc = F.col("b") + F.col("c")
    return t.withColumn("chi2", F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / bc)


def chi2_sf_1(x: Column) -> Column:
    """Survival function of chi-square with 1 dof: erfc(sqrt(x/2)) (vectorised pandas UDF)."""

    @F.pandas_udf("double")
    def _sf(s):
        import math as _m

        return s.apply(lambda v: _m.erfc(_m.sqrt(v / 2.0)) if v == v else float("nan"))

    return _sf(x)


def significance(p: Column) -> Column:
    """M15: '***' / '**' / '*' / 'n.s.'."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def neg_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-6)))


# ------------------------------------------------------------------ thresholds


def calibrate_thresholds(pr: DataFrame) -> DataFrame:
    """M4: per class, the PR-curve threshold with the best F1 = 2PR/(P+R+1e-9).

    ``pr`` is the point table of ``evaluate.pr_curve`` without the final
    (recall 0, precision 1) point; ties -> the smallest threshold (first in
    ascending order).  Classes with no point default to 0.5.
    """
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPS_F1))
    best = pr.withColumn("f1", f1).groupBy("class").agg(
        F.min_by(F.struct(F.col("threshold"), F.col("f1")), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")
    )
    return best.select("class", F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def apply_thresholds(df: DataFrame, classes: list[str], proba_cols: list[str], thresholds: dict[str, float],
                     out: str = "predicted_calibrated") -> DataFrame:
    """M5: argmax of (p - threshold); if no class passes, argmax of p (first index wins ties)."""
    margins = [F.col(p) - F.lit(thresholds.get(c, 0.5)) for c, p in zip(classes, proba_cols)]

    def argmax(exprs):
        best = F.lit(classes[-1])
        for i in reversed(range(len(exprs) - 1)):
            cond = F.lit(True)
            for j in range(len(exprs)):
                if j != i:
                    cond = cond & ((exprs[i] > exprs[j]) if j < i else (exprs[i] >= exprs[j]))
            best = F.when(cond, F.lit(classes[i])).otherwise(best)
        return best

    none_pass = F.greatest(*margins) < 0
    probs = [F.col(p) for p in proba_cols]
    return df.withColumn(out, F.when(none_pass, argmax(probs)).otherwise(argmax(margins)))


# ------------------------------------------------------------------ bootstrap


def bootstrap_ci(cells: DataFrame, n_boot: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile CIs of macro-F1 and per-class recall.

    Resampling rows with replacement is a multinomial draw over the k x k
    confusion cells, so only the cells are shipped: replicates are spread
    over partitions with ``spark.range`` and each draws from a seeded
    generator keyed by the replicate number (independent of partitioning).
    """
    spark = cells.sparkSession
    c = cells.collect()  # k x k rows
    labels = sorted({r["actual"] for r in c} | {r["predicted"] for r in c})
    idx = {l: i for i, l in enumerate(labels)}
    k = len(labels)
    m = np.zeros((k, k))
    for r in c:
        m[idx[r["actual"]], idx[r["predicted"]]] += r["n"]
    flat = m.ravel().tolist()
    parts = max(1, min(64, n_boot // 100))

    def draw(batches):
        import numpy as _np
        import pandas as _pd

        mat = _np.array(flat).reshape(k, k)
        n = mat.sum()

        def macro_f1(t):
            tp = _np.diag(t)
            sup = t.sum(axis=1)
            prd = t.sum(axis=0)
            present = (sup + prd) > 0
            prec = _np.divide(tp, prd, out=_np.zeros(k), where=prd > 0)
            rec = _np.divide(tp, sup, out=_np.zeros(k), where=sup > 0)
            f1 = _np.divide(2 * prec * rec, prec + rec, out=_np.zeros(k), where=(prec + rec) > 0)
            return float(f1[present].mean()) if present.any() else 0.0

        for pdf in batches:
            out = []
            for b in pdf["id"]:
                rng = _np.random.default_rng([seed, int(b)])
                t = rng.multinomial(int(n), (mat / n).ravel()).reshape(k, k)
                out.append((int(b), "macro_f1", macro_f1(t)))
                for i, lab in enumerate(labels):
                    ni = int(mat[i].sum())
                    if ni > 0:
                        row = rng.multinomial(ni, mat[i] / ni)
                        out.append((int(b), f"recall_{lab}", float(row[i] / ni)))
            yield _pd.DataFrame(out, columns=["replicate", "statistic", "value"])

    reps = spark.range(0, n_boot, 1, parts).mapInPandas(draw, "replicate long, statistic string, value double")
    ci = reps.groupBy("statistic").agg(
        F.percentile("value", F.lit(alpha / 2)).alias("lo"), F.percentile("value", F.lit(1 - alpha / 2)).alias("hi"),
        F.count(F.lit(1)).alias("replicates"),
    )
    obs_rows = [("macro_f1", _macro_f1_np(m))] + [
        (f"recall_{lab}", float(m[i, i] / m[i].sum())) for i, lab in enumerate(labels) if m[i].sum() > 0
    ]
    obs = spark.createDataFrame(obs_rows, "statistic string, observed double")
    return obs.join(ci, "statistic")


def _macro_f1_np(t: np.ndarray) -> float:
    k = t.shape[0]
    tp, sup, prd = np.diag(t), t.sum(axis=1), t.sum(axis=0)
    present = (sup + prd) > 0
    prec = np.divide(tp, prd, out=np.zeros(k), where=prd > 0)
    rec = np.divide(tp, sup, out=np.zeros(k), where=sup > 0)
    f1 = np.divide(2 * prec * rec, prec + rec, out=np.zeros(k), where=(prec + rec) > 0)
    return float(f1[present].mean()) if present.any() else 0.0


# ------------------------------------------------------------------ stability (M7, M9)


def stability(delta: Column, limit: float = STABLE_DELTA) -> Column:
    """M7: 'STABLE' if |delta| < limit else 'DROP'."""
    return F.when(F.abs(delta) < F.lit(limit), "STABLE").otherwise("DROP")


def sensitivity_status(values: list[float]) -> str:
    """M9: range of scores across rebalance ratios < 0.02 -> 'STABLE'."""
    return "STABLE" if values and (max(values) - min(values)) < SENSITIVITY_RANGE else "SENSITIVE"


__all__ = ["math"]
