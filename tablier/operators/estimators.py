"""Spark ML estimators (K1-K9, K12-K18) behind one registry.

Training data is assembled once into a ``features`` vector for a driver loop
over models (K15). A fit reads its rows many times, so they are dealt out to
all cores and cached for it; each fit/score is a distributed Spark ML job.
Learners of many rounds that take a weight per row get equal rows (categorical
columns make many) as one weighted row, where that halves the rows at least.
Learners that draw rows or count those of a leaf get them as a few weighted rows.
Trees of many levels keep the node of each row from level to level.
Multi-class boosting uses one-vs-rest (``GBTClassifier`` is binary).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..session import cut_lineage
from .running import BYTES_PER_TASK, ROWS_PER_TASK, spread


BUNDLES = 4_000  # rows that any number of equal rows become, where rows are drawn
LEAF_ROWS = 20  # of a leaf of hist_gradient_boosting at least
HIST_BINS = 255  # of a feature in hist_gradient_boosting; Spark looks for their bounds in the square of that many rows


@dataclass
class ModelSpec:
    name: str
    family: str
    supports_weights: bool
    task: str = "classification"
    params: dict = field(default_factory=dict)


# Fixed defaults that mirror the reference's model registry.
REGISTRY: dict[str, ModelSpec] = {
    "logistic_regression": ModelSpec("logistic_regression", "linear", True, params={"C": 1.0, "l1_ratio": 0.0, "max_iter": 100, "tol": 1e-4}),
    "random_forest": ModelSpec("random_forest", "tree", True, params={"n_estimators": 100, "max_depth": 30}),
    "extra_trees": ModelSpec("extra_trees", "tree", True, params={"n_estimators": 100, "max_depth": 30}),
    "decision_tree": ModelSpec("decision_tree", "tree", True, params={"max_depth": 30}),
    "gaussian_nb": ModelSpec("gaussian_nb", "bayes", True),
    "knn": ModelSpec("knn", "neighbours", False, params={"n_neighbors": 5}),
    "xgboost": ModelSpec("xgboost", "boosting", True, params={"n_estimators": 300, "learning_rate": 0.05, "max_depth": 5}),
    "gradient_boosting": ModelSpec("gradient_boosting", "boosting", False, params={"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}),
    "hist_gradient_boosting": ModelSpec("hist_gradient_boosting", "boosting", True, params={"max_iter": 100}),
    "adaboost": ModelSpec("adaboost", "boosting", False, params={"n_estimators": 50, "learning_rate": 1.0}),
    "svc": ModelSpec("svc", "kernel", True, params={"n_components": 256, "gamma": None}),
    "neural_net": ModelSpec("neural_net", "neural", False, params={"hidden": 64, "max_iter": 100}),
    "linear_regression": ModelSpec("linear_regression", "linear", False, task="regression"),
    "random_forest_regressor": ModelSpec("random_forest_regressor", "tree", False, task="regression", params={"n_estimators": 200}),
}
ALIASES = {"lr": "logistic_regression", "rf": "random_forest", "et": "extra_trees", "dt": "decision_tree",
           "gbt": "gradient_boosting", "hgb": "hist_gradient_boosting", "mlp": "neural_net"}


def lookup(name: str) -> ModelSpec:
    key = (name or "").strip().lower().replace(" ", "_")
    key = ALIASES.get(key, key)
    if key not in REGISTRY:
        raise KeyError(f"Unknown model '{name}'.")
    return REGISTRY[key]


def configured(name: str, params: dict | None = None) -> ModelSpec:
    """The registered model with the user's parameters over its defaults; unknown names are refused."""
    spec = lookup(name)
    unknown = sorted(set(params or {}) - set(spec.params))
    if unknown:
        raise ValueError(f"{spec.name} has no parameter {', '.join(unknown)}.")
    return replace(spec, params={**spec.params, **(params or {})})


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType.simpleString(), str) \
            and df.schema[features[0]].dataType.simpleString().startswith("array"):
        return df.withColumn(out, array_to_vector(F.col(features[0]).cast("array<double>")))
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def _n_classes(df: DataFrame, label: str) -> int:
    return int(df.agg(F.max(label)).collect()[0][0]) + 1


# deep trees: without it each level takes every row down every tree from the root again; the splits are the same
NODES = {"cacheNodeIds": True, "checkpointInterval": 10}


def make_estimator(spec: ModelSpec, n_classes: int, n_rows_weight: float, seed: int = 42, weight_col: str | None = None):
    p = spec.params
    wc = {"weightCol": weight_col} if (weight_col and spec.supports_weights) else {}
    if spec.name == "logistic_regression":
        # sklearn C*sum(loss) + 0.5||w||^2  ==  mean(loss) + (1/(C*sum w)) * 0.5||w||^2
        return LogisticRegression(regParam=1.0 / (p["C"] * n_rows_weight), elasticNetParam=p["l1_ratio"], standardization=False,
                                  maxIter=p["max_iter"], tol=p["tol"], family="auto", **wc)
    if spec.name == "random_forest":
        return RandomForestClassifier(numTrees=p["n_estimators"], featureSubsetStrategy="sqrt", bootstrap=True,
                                      maxDepth=p["max_depth"], seed=seed, **NODES, **wc)
    if spec.name == "extra_trees":
        # documented substitution: no bootstrap, random feature subsets; split thresholds are not random
        return RandomForestClassifier(numTrees=p["n_estimators"], featureSubsetStrategy="sqrt", bootstrap=False,
                                      maxDepth=p["max_depth"], seed=seed, **NODES, **wc)
    if spec.name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=p["max_depth"], seed=seed, **NODES, **wc)
    if spec.name == "gaussian_nb":
        return NaiveBayes(modelType="gaussian", **wc)
    if spec.name in ("xgboost", "gradient_boosting", "hist_gradient_boosting"):
        if spec.name == "xgboost":
            g = GBTClassifier(maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"],
                              subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, **wc)
        elif spec.name == "gradient_boosting":
            g = GBTClassifier(maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=seed)
        else:
            g = GBTClassifier(maxIter=p["max_iter"], maxBins=HIST_BINS, maxDepth=5, minInstancesPerNode=LEAF_ROWS, seed=seed, **wc)
        return g if n_classes <= 2 else OneVsRest(classifier=g, parallelism=4, **wc)
    if spec.name == "neural_net":
        return None  # layers depend on the feature count; built in fit_model
    if spec.name == "linear_regression":
        return LinearRegression(regParam=0.0, solver="normal")
    if spec.name == "random_forest_regressor":
        return RandomForestRegressor(numTrees=p["n_estimators"], seed=42)
    return None


@dataclass
class Fitted:
    name: str
    model: object
    n_classes: int
    kind: str = "spark"
    extra: dict = field(default_factory=dict)


def fit_model(name: str, train: DataFrame, label: str = "label", features_col: str = "features", seed: int = 42,
              weight_col: str | None = None, n_classes: int | None = None, n_features: int | None = None,
              params: dict | None = None) -> Fitted:
    """``params`` replace the registry's defaults; ``weight_col`` reaches every model that supports weights."""
    spec = configured(name, params)
    k = n_classes or (_n_classes(train, label) if spec.task == "classification" else 0)
    if spec.name == "knn":
        rows = train.select(vector_to_array(features_col).alias("_x"), F.col(label).cast("int").alias("_y"))
        return Fitted(name, None, k, kind="knn", extra={"train": _numbered(rows, "t"), "k": spec.params["n_neighbors"], "seed": seed})
    columns = [features_col, label, *([weight_col] if weight_col else [])]
    train = train.select(*dict.fromkeys(columns))
    # draws no rows, but counts those of a leaf: for that, LEAF_ROWS bundles are as good as any more equal rows
    fewer = bundled(train, features_col, label, weight_col, LEAF_ROWS, HIST_BINS ** 2) if spec.name == "hist_gradient_boosting" else None
    if fewer is None:
        train = _dealt_out(train, spec, features_col)
    else:
        train, weight_col = fewer, "_n"
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(name, spec, train, label, features_col, seed, weight_col, k, n_features)
    finally:
        train.unpersist()


def _dealt_out(train: DataFrame, spec: ModelSpec, features_col: str) -> DataFrame:
    """The rows of a fit over all cores; a forest holds a count per tree and row, a kernel its components."""
    rows, vector = train.agg(F.count(F.lit(1)), F.first(features_col, ignorenulls=True)).first()
    width = len(vector) if vector is not None else 0
    counts = spec.params.get("n_estimators", 1) if spec.family == "tree" else 0
    return spread(train, rows, 100 + 8 * (width + spec.params.get("n_components", 0)) + 4 * counts)


def folded(train: DataFrame, features_col: str, label: str, weight_col: str | None = None) -> DataFrame | None:
    """Equal rows as one with their number, or their sum of weights, as ``_n``; None where that leaves more than half of the rows.

    A sum over weighted rows is the sum over all of them, so a loss, an impurity or a vote keeps its value.
    """
    weight = F.sum(weight_col) if weight_col else F.count(F.lit(1)).cast("double")
    rows = train.groupBy(features_col, label).agg(weight.alias("_n"), F.count(F.lit(1)).alias("_rows"))
    made, given = rows.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if 2 * made > (given or 0):
        return None
    rows = rows.drop("_rows")
    return rows.coalesce(1) if made <= ROWS_PER_TASK else spread(rows, made, 100)


def bundled(train: DataFrame, features_col: str, label: str, weight_col: str | None = None, bundles: int = BUNDLES,
            even: int | None = None) -> DataFrame | None:
    """Equal rows as at most ``bundles`` rows of even size, their weight as ``_n``, for a learner that draws rows at random each round.

    All weight is kept, and a round draws the same share of it as of the rows, each bundle by itself: of equal rows the drawn
    share differs from that by 0.5 / sqrt(bundles) of it, not by 0.5 / sqrt(rows). None where more than half of the rows would be left.

    A learner that splits a node only into parts of ``bundles`` rows at least splits the bundles as it splits the rows: equal rows are
    in one node, so it has that many bundles where it has that many rows. Where ``even`` is given and more bundles than that come of
    it, so that the learner draws ``even`` of them to look for its cut values, no bundle holds more than 1 / ``even`` of the rows.
    """
    key = [features_col, label, *([weight_col] if weight_col else [])]
    equal = train.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    parts = F.least("_rows", F.lit(bundles)).cast("int")
    made, given = equal.agg(F.sum(parts), F.sum("_rows")).first()
    if even and made and made > even:
        parts = F.greatest(parts, F.ceil(F.col("_rows") * even / given).cast("int"))
        made = equal.agg(F.sum(parts)).first()[0]
    if not given or 2 * made > given:
        return None
    equal = equal.withColumn("_parts", parts)
    equal = equal.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    size = F.expr("_rows div _parts") + (F.col("_part") < F.expr("_rows % _parts")).cast("long")
    weight = size * F.col(weight_col) if weight_col else size
    rows = equal.select(features_col, label, weight.cast("double").alias("_n"))
    return rows.coalesce(1) if made <= ROWS_PER_TASK else spread(rows, made, 100)


def _fit(name: str, spec: ModelSpec, train: DataFrame, label: str, features_col: str, seed: int, weight_col: str | None, k: int,
         n_features: int | None) -> Fitted:
    if spec.name == "adaboost":
        return fit_adaboost(train, label, features_col, k, spec.params["n_estimators"], spec.params["learning_rate"], seed)
    if spec.name == "svc":
        return fit_svc_rff(train, label, features_col, k, n_features, spec.params["n_components"], seed, weight_col, spec.params["gamma"])
    if spec.name == "neural_net":
        nf = n_features or len(train.select(features_col).first()[0])
        mlp = MultilayerPerceptronClassifier(layers=[nf, spec.params["hidden"], k], maxIter=spec.params["max_iter"], seed=seed)
        return Fitted(name, mlp.fit(train), k)
    wsum = float(train.agg(F.sum(weight_col)).collect()[0][0]) if weight_col else float(train.count())
    est = make_estimator(spec, k, wsum, seed, weight_col)
    est.setParams(featuresCol=features_col, labelCol=label) if not isinstance(est, OneVsRest) else \
        est.setFeaturesCol(features_col).setLabelCol(label)
    if isinstance(est, OneVsRest):
        est.getClassifier().setFeaturesCol(features_col).setLabelCol(label)
    if spec.name == "gradient_boosting":  # samples no rows and counts none for a leaf
        fewer = folded(train, features_col, label)
        if fewer is not None:
            return Fitted(name, _fit_cached(est.setWeightCol("_n"), fewer), k)
    if spec.name == "xgboost":  # draws rows each round, but counts none for a leaf
        fewer = bundled(train, features_col, label, weight_col)
        if fewer is not None:
            return Fitted(name, _fit_cached(est.setWeightCol("_n"), fewer), k)
    return Fitted(name, est.fit(train), k)


def _fit_cached(est, rows: DataFrame):
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return est.fit(rows)
    finally:
        rows.unpersist()


def score(fitted: Fitted, df: DataFrame, features_col: str = "features") -> DataFrame:
    """Adds ``prediction`` and class-aligned ``proba`` (array of k doubles)."""
    if fitted.kind == "adaboost":
        return score_adaboost(fitted, df, features_col)
    if fitted.kind == "svc":
        return score_svc(fitted, df, features_col)
    if fitted.kind == "knn":
        return score_knn(fitted, df, features_col)
    out = fitted.model.transform(df)
    k = fitted.n_classes
    if "probability" in out.columns:
        arr = vector_to_array("probability")
        proba = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                            lambda i: F.coalesce(F.element_at(arr, i + 1), F.lit(0.0)))
    elif "rawPrediction" in out.columns and k > 0:
        # OvR: normalise the k positive margins into a distribution (order is what AUC needs)
        raw = vector_to_array("rawPrediction")
        ex = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
        proba = F.transform(ex, lambda x: x / tot)
    else:
        proba = F.array().cast("array<double>")
    return out.withColumn("proba", proba)


# ------------------------------------------------------------------ k-NN


def _numbered(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with a stable ``_id``: the numbers are fixed by the checkpoint."""
    return cut_lineage(df.withColumn("_id", F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string"))))


def score_knn(f: Fitted, df: DataFrame, features_col: str) -> DataFrame:
    """Share of each class among the k nearest training rows; the smallest class wins ties."""
    from .knn import knn_within_groups

    rows, train = _numbered(df, "q"), f.extra["train"]
    asked = rows.select("_id", vector_to_array(features_col).alias("_x"), F.lit(True).alias("_ask"))
    both = asked.unionByName(train.select("_id", "_x", F.lit(False).alias("_ask")))
    nn = knn_within_groups(both, "_id", None, "_x", f.extra["k"], f.extra["seed"], query=F.col("_ask"), member=~F.col("_ask"))
    shares = [(F.count_if(F.col("_y") == c) / F.count(F.lit(1))).alias(f"_s{c}") for c in range(f.n_classes)]
    votes = nn.join(train.select(F.col("_id").alias("nn_key"), "_y"), "nn_key").groupBy(F.col("key").alias("_id")).agg(*shares)
    proba = F.array(*[F.coalesce(f"_s{c}", F.lit(0.0)) for c in range(f.n_classes)])
    out = rows.join(votes, "_id", "left").withColumn("proba", proba)
    best = (F.array_position("proba", F.array_max("proba")) - 1).cast("double")
    return out.select(*df.columns, "proba", best.alias("prediction"))


# ------------------------------------------------------------------ AdaBoost (K8): SAMME


def fit_adaboost(train: DataFrame, label: str, features_col: str, k: int, rounds: int = 50, lr: float = 1.0,
                 seed: int = 42) -> Fitted:
    """SAMME (Zhu et al. 2009): stumps on a weight column updated by expression.

    A round reads its rows several times, so their weights are cached, one round
    at a time; lineage is cut with a reliable checkpoint every 10 rounds.
    """
    data = folded(train, features_col, label)
    data = data.withColumnRenamed("_n", "_w") if data is not None else train.select(features_col, label).withColumn("_w", F.lit(1.0))
    n = train.count()
    data = data.withColumn("_w", F.col("_w") / F.lit(float(n))).persist(StorageLevel.MEMORY_AND_DISK)
    held = [data]
    stumps, alphas = [], []
    for r in range(rounds):
        dt = DecisionTreeClassifier(maxDepth=1, featuresCol=features_col, labelCol=label, weightCol="_w", seed=seed + r)
        m = dt.fit(data)
        # only the prediction is asked for: no raw votes or probabilities of each row
        m = m.setRawPredictionCol("").setProbabilityCol("").setPredictionCol("_p")
        pred = m.transform(data).select(features_col, label, "_w", "_p")
        # one pass gives both the weighted error and the new normaliser
        agg = pred.agg(F.sum(F.when(F.col("_p") != F.col(label), F.col("_w")).otherwise(0.0)).alias("miss"),
                       F.sum("_w").alias("tot")).collect()[0]
        if not agg["tot"]:
            break
        err = agg["miss"] / agg["tot"]
        if err <= 0:
            stumps.append(m)
            alphas.append(1.0)
            break
        if err >= 1 - 1.0 / max(k, 2):
            break
        alpha = lr * (math.log((1 - err) / err) + math.log(max(k, 2) - 1))
        stumps.append(m)
        alphas.append(alpha)
        new_tot = (agg["tot"] - agg["miss"]) + agg["miss"] * math.exp(alpha)
        upd = F.when(F.col("_p") != F.col(label), F.col("_w") * F.lit(math.exp(alpha))).otherwise(F.col("_w"))
        data = pred.withColumn("_w", upd / F.lit(new_tot)).drop("_p")
        if (r + 1) % 10 == 0:
            data = cut_lineage(data)
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(data)
        if len(held) > 2:  # the last two: the new weights are made from the ones before
            held.pop(0).unpersist()
    for rows in held:
        rows.unpersist()
    return Fitted("adaboost", None, k, kind="adaboost", extra={"stumps": stumps, "alphas": alphas})


def score_adaboost(f: Fitted, df: DataFrame, features_col: str) -> DataFrame:
    k = f.n_classes
    out = df
    votes = [F.lit(0.0)] * k
    for i, (m, a) in enumerate(zip(f.extra["stumps"], f.extra["alphas"])):
        out = m.setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("").transform(out)
        votes = [v + F.when(F.col(f"_p{i}") == c, F.lit(a)).otherwise(0.0) for c, v in enumerate(votes)]
    arr = F.array(*votes)
    # SAMME decision -> probabilities via softmax of votes / (k - 1)
    scale = F.lit(1.0 / max(k - 1, 1))
    ex = F.transform(arr, lambda x: F.exp((x - F.array_max(arr)) * scale))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
    out = out.withColumn("proba", F.transform(ex, lambda x: x / tot))
    out = out.withColumn("prediction", (F.array_position(arr, F.array_max(arr)) - 1).cast("double"))
    return out.drop(*[f"_p{i}" for i in range(len(f.extra["stumps"]))])


# ------------------------------------------------------------------ SVC (K9): random Fourier features


def fit_svc_rff(train: DataFrame, label: str, features_col: str, k: int, n_features: int | None,
                n_components: int = 256, seed: int = 42, weight_col: str | None = None, gamma: float | None = None) -> Fitted:
    """RBF kernel approximated by random Fourier features (Rahimi & Recht 2007),
    LinearSVC one-vs-rest, Platt scaling by a logistic regression on the margins.

    Where the components of all rows are many, they are kept on disk and one class
    at a time holds its blocks: rows and blocks of all classes took four times that.
    """
    d = n_features or len(train.select(features_col).first()[0])
    var = train.select(vector_to_array(features_col).alias("a")).select(F.explode("a").alias("x")).agg(F.var_pop("x")).collect()[0][0] or 1.0
    gamma = gamma or 1.0 / (d * var)  # 'scale' default
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, d))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    n = rows = train.count()
    fewer = folded(train, features_col, label, weight_col)
    if fewer is not None:
        train, weight_col = fewer.persist(StorageLevel.MEMORY_AND_DISK), "_n"
        rows = train.count()
    wc = {"weightCol": weight_col} if weight_col else {}
    many = rows * 8 * n_components > BYTES_PER_TASK
    feats = rff_transform(train, features_col, w, b, "_rff")
    if many:
        feats = feats.persist(StorageLevel.DISK_ONLY)
    svc = LinearSVC(featuresCol="_rff", labelCol=label, regParam=1.0 / max(1, n), maxIter=100, tol=1e-4, **wc)
    ovr = OneVsRest(classifier=svc, featuresCol="_rff", labelCol=label, parallelism=1 if many else 4, **wc)
    model = ovr.fit(feats)
    margins = model.transform(feats).withColumn("_m", vector_to_array("rawPrediction")).withColumn("_mv", array_to_vector("_m"))
    margins = margins.drop("rawPrediction", "prediction")
    platt = LogisticRegression(featuresCol="_mv", labelCol=label, regParam=1e-4, maxIter=100, **wc).fit(margins)
    for held in (feats if many else None, train if fewer is not None else None):
        if held is not None:
            held.unpersist()
    return Fitted("svc", model, k, kind="svc", extra={"w": w, "b": b, "platt": platt})


def rff_transform(df: DataFrame, features_col: str, w: np.ndarray, b: np.ndarray, out: str) -> DataFrame:
    """z(x) = sqrt(2/m) cos(W x + b): dense per-row algebra, so an Arrow-batched numpy UDF."""
    m = w.shape[0]
    wt, bb, scale = w.T.copy(), b.copy(), math.sqrt(2.0 / m)

    @F.pandas_udf("array<double>")
    def rff(arrs):
        import numpy as _np
        import pandas as _pd

        if len(arrs) == 0:
            return _pd.Series([], dtype=object)
        x = _np.vstack(arrs.to_numpy())
        z = scale * _np.cos(x @ wt + bb)
        return _pd.Series(list(z))

    return df.withColumn(out, array_to_vector(rff(vector_to_array(features_col))))


def score_svc(f: Fitted, df: DataFrame, features_col: str) -> DataFrame:
    x = rff_transform(df, features_col, f.extra["w"], f.extra["b"], "_rff")
    m = f.model.transform(x).withColumn("_m", vector_to_array("rawPrediction")).withColumn("_mv", array_to_vector("_m"))
    m = m.drop("rawPrediction")
    p = f.extra["platt"].setFeaturesCol("_mv").setPredictionCol("prediction").setProbabilityCol("_prob").setRawPredictionCol("_praw")
    out = p.transform(m.drop("prediction"))
    arr = vector_to_array("_prob")
    proba = F.transform(F.sequence(F.lit(0), F.lit(f.n_classes - 1)), lambda i: F.coalesce(F.element_at(arr, i + 1), F.lit(0.0)))
    return out.withColumn("proba", proba).drop("_rff", "_m", "_mv", "_praw", "_prob")


# ------------------------------------------------------------------ inspection


def coefficients(spark, fitted: Fitted, feature_names: list[str], class_labels: list[str]) -> DataFrame:
    """(class, feature, coefficient, odds_ratio); binary models are labelled with the positive class."""
    m = fitted.model
    cm = m.coefficientMatrix.toArray()
    rows = []
    labels = class_labels[1:] if cm.shape[0] == 1 else class_labels
    for ci, lab in enumerate(labels):
        for fi, name in enumerate(feature_names):
            c = float(cm[ci, fi])
            rows.append((str(lab), name, c, math.exp(c) if c < 700 else float("inf")))
    return spark.createDataFrame(rows, "class string, feature string, coefficient double, odds_ratio double")


def importances(spark, fitted: Fitted, feature_names: list[str]) -> DataFrame:
    """(feature, importance) descending."""
    imp = fitted.model.featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(feature_names, imp)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def row_cap(df: DataFrame, key: str, cap: int, seed: int = 42) -> DataFrame:
    """Seeded cap (without replacement) before a size-limited learner."""
    from .ranking import mark_first, quota_of
    from ..functions.hashing import hash_sort_key

    if df.count() <= cap:
        return df
    return mark_first(df, hash_sort_key(df, seed, key), None, quota_of(cap), "_kept").where("_kept").drop("_kept")


__all__ = ["uniform", "Pipeline"]
