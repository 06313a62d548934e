"""Validation workflows.

Each workflow is a small driver loop (folds, models, fractions) whose every
step is a distributed fit / score / aggregate; results are long DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as E
from . import split as S
from .estimators import fit_model, score
from .imbalance import with_weight_column
from .running import written

METRICS = ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", "roc_auc")


def metrics_row(scored: DataFrame, label: str = "label", n_classes: int = 0) -> DataFrame:
    """One row of metrics; with ``n_classes`` also ``roc_auc`` (null where a class has no positive or no negative)."""
    cells = E.observed_cells(scored.select(F.col(label).cast("int").alias("a"), F.col("prediction").cast("int").alias("p")), "a", "p")
    row = E.classification_metrics(cells)
    if n_classes < 2:
        return row
    names = [f"p{c}" for c in range(n_classes)]
    wide = scored.select(F.col(label).cast("int").alias("a"), *[F.element_at("proba", c + 1).alias(f"p{c}") for c in range(n_classes)])
    counts = E.score_counts(wide, "a", [str(c) for c in range(n_classes)], names, positive_only=True)
    return row.crossJoin(E.roc_auc(counts))


def stratified_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """The rows with their ``fold`` (G13), written once: several models may read the same folds."""
    S.assert_cv_feasible(df, label, k)
    return written(S.kfold_stratified(df, key, label, k, seed), "folds")


def cross_validate(df: DataFrame, key: str, model: str, k: int = 5, seed: int = 42, label: str = "label",
                   features_col: str = "features", folds: DataFrame | None = None) -> DataFrame:
    """M1: stratified k-fold (G13) on the given (already balanced) rows; five metrics per fold.

    ``folds`` are those of ``stratified_folds``, where another model was given them too.
    """
    folds = stratified_folds(df, key, k, seed, label) if folds is None else folds
    n_classes = int(df.agg(F.max(label)).collect()[0][0]) + 1
    out = None
    for f in range(k):
        fitted = fit_model(model, folds.where(F.col("fold") != f), label, features_col, seed, n_classes=n_classes)
        m = metrics_row(score(fitted, folds.where(F.col("fold") == f), features_col), label, n_classes)
        m = m.withColumn("fold", F.lit(f)).withColumn("model", F.lit(model))
        out = m if out is None else out.unionByName(m)
    return written(out, "cv")


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and population std across folds, ignoring missing values."""
    long = cv.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS
    ])).alias("x")).select("model", "x.metric", "x.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("folds")
    )


def group_cv_oof(df: DataFrame, key: str, group: str, model: str, k: int = 5, seed: int = 42, label: str = "label",
                 features_col: str = "features", rebalance=None) -> DataFrame:
    """M3: stratified group folds (G14), out-of-fold scores.

    ``rebalance`` turns the training rows of a fold into those to fit on; the
    rows that are scored are always the input rows, each once.
    """
    folds = written(S.kfold_group(df, label, group, k, seed), "folds")
    n_classes = int(df.agg(F.max(label)).collect()[0][0]) + 1
    oof = None
    for f in range(k):
        train = folds.where(F.col("fold") != f)
        if rebalance is not None:
            train = rebalance(train)
        fitted = fit_model(model, train, label, features_col, seed, n_classes=n_classes)
        s = score(fitted, folds.where(F.col("fold") == f), features_col).select(key, label, "fold", "prediction", "proba")
        oof = s if oof is None else oof.unionByName(s)
    return oof


def class_f1(scored: DataFrame, cls: int, label: str = "label") -> float:
    r = scored.agg(
        F.count_if((F.col("prediction") == cls) & (F.col(label) == cls)).alias("tp"),
        F.count_if(F.col("prediction") == cls).alias("pp"),
        F.count_if(F.col(label) == cls).alias("ap"),
    ).collect()[0]
    p = r["tp"] / r["pp"] if r["pp"] else 0.0
    rc = r["tp"] / r["ap"] if r["ap"] else 0.0
    return 2 * p * rc / (p + rc) if p + rc else 0.0


def stacking(train: DataFrame, test: DataFrame, key: str, group: str, models: list[str], chosen_class: int, k: int = 5,
             seed: int = 42, label: str = "label", features_col: str = "features", top: int = 3) -> DataFrame:
    """M6: top bases by OOF F1 of one class; a class-weighted logistic regression (C = 1) learns from their
    OOF probabilities and is scored on the ``test`` probabilities of the bases refitted on all training rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n_classes = int(train.agg(F.max(label)).collect()[0][0]) + 1
    oofs = {m: group_cv_oof(train, key, group, m, k, seed, label, features_col).cache() for m in models}
    try:
        ranked = sorted(models, key=lambda m: -class_f1(oofs[m], chosen_class, label))[:top]
        if len(ranked) < 2:
            raise ValueError("Stacking needs at least two base models.")

        def side_by_side(parts: dict[str, DataFrame]) -> DataFrame:
            out = None
            for m in ranked:
                part = parts[m].select(key, label, F.col("proba").alias(f"proba_{m}"))
                out = part if out is None else out.join(part.drop(label), key)  # E6
            return out.withColumn("meta", array_to_vector(F.concat(*[F.col(f"proba_{m}") for m in ranked])))

        meta = with_weight_column(side_by_side(oofs), label, "w")
        weight = float(meta.agg(F.sum("w")).collect()[0][0])
        lr = LogisticRegression(featuresCol="meta", labelCol=label, weightCol="w", maxIter=100, regParam=1.0 / weight,
                                standardization=False).fit(meta)
        bases = {m: score(fit_model(m, train, label, features_col, seed, n_classes=n_classes), test, features_col) for m in ranked}
        return metrics_row(lr.transform(side_by_side(bases)), label).withColumn("bases", F.lit(",".join(ranked)))
    finally:
        for f in oofs.values():
            f.unpersist()


def learning_curve(df: DataFrame, key: str, group: str, model: str, fractions=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
                   k: int = 3, seed: int = 42, label: str = "label", min_rare: int = 6) -> DataFrame:
    """M8: group-subsampled training sizes x group CV; skipped when a class is too rare or folds < 2."""
    from ..session import cut_lineage

    rows = None
    for fr in fractions:
        sub = cut_lineage(S.learning_curve_sample(df, group, fr, seed))
        counts = {r[0]: r[1] for r in sub.groupBy(label).count().collect()}
        if not counts or min(counts.values()) < min_rare or k < 2:
            continue
        oof = group_cv_oof(sub, key, group, model, k, seed, label)
        m = metrics_row(oof, label).withColumn("fraction", F.lit(fr)).withColumn("rows", F.lit(sum(counts.values())))
        rows = m if rows is None else rows.unionByName(m)
    return rows


def learning_curve_folds(df: DataFrame, key: str, group: str, model: str, fractions=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), k: int = 3,
                         seed: int = 42, label: str = "label", min_rare: int = 6, rebalance=None) -> DataFrame:
    """M8 with the folds kept apart: mean and population deviation of macro-F1 over the folds of each training size."""
    rows = None
    for fraction in fractions:
        sub = written(S.learning_curve_sample(df, group, fraction, seed), "curve-sample")
        size = sub.groupBy(label).count().agg(F.sum("count"), F.min("count")).first()
        if not size[0] or size[1] < min_rare or k < 2:
            continue
        oof = written(group_cv_oof(sub, key, group, model, k, seed, label, rebalance=rebalance), "curve-oof")
        for f in range(k):
            m = metrics_row(oof.where(F.col("fold") == f), label).select("macro_f1", F.lit(fraction).alias("fraction"), F.lit(size[0]).alias("rows"))
            rows = m if rows is None else rows.unionByName(m)
    if rows is None:
        return df.sparkSession.createDataFrame([], "fraction double, rows long, macro_f1_mean double, macro_f1_std double, folds long")
    return rows.groupBy("fraction", "rows").agg(
        F.avg("macro_f1").alias("macro_f1_mean"), F.stddev_pop("macro_f1").alias("macro_f1_std"), F.count("macro_f1").alias("folds")
    )


def train_many(train: DataFrame, test: DataFrame, models: list[str], label: str = "label",
               features_col: str = "features", seed: int = 42, class_weights: bool = False,
               params: dict[str, dict] | None = None) -> DataFrame:
    """One row per model; a failing model becomes a 'failed' row, unknown -> 'skipped'.

    ``params`` holds parameters per model name; ``class_weights`` gives balanced
    weights to every model that supports them.
    """
    spark = train.sparkSession
    if class_weights:
        train = with_weight_column(train, label, "_weight")
    train = train.cache()
    n_classes = int(train.agg(F.max(label)).collect()[0][0]) + 1
    rows = []
    for m in models:
        try:
            fitted = fit_model(m, train, label, features_col, seed, "_weight" if class_weights else None, n_classes,
                               params=(params or {}).get(m))
            r = metrics_row(score(fitted, test, features_col), label, n_classes).collect()[0]
            rows.append((m, "trained", *[float(r[x]) if r[x] is not None else None for x in METRICS], None))
        except KeyError as exc:
            rows.append((m, "skipped", None, None, None, None, None, str(exc)))
        except Exception as exc:  # noqa: BLE001  (fault isolation: one model's failure is a row)
            rows.append((m, "failed", None, None, None, None, None, f"{type(exc).__name__}: {exc}"[:500]))
    train.unpersist()
    schema = "model string, status string, " + ", ".join(f"{x} double" for x in METRICS) + ", error string"
    return spark.createDataFrame(rows, schema)


def predictions_table(scored: DataFrame, key: str, class_labels: list[str], label: str = "label") -> DataFrame:
    """(key, actual, predicted, prob_<class>) with decoded labels."""
    arr = F.array(*[F.lit(c) for c in class_labels])
    cols = [F.col(key), F.element_at(arr, F.col(label).cast("int") + 1).alias("actual"),
            F.element_at(arr, F.col("prediction").cast("int") + 1).alias("predicted")]
    names = [str(c).replace("\n", " ").strip() for c in class_labels]  # D13
    cols += [F.element_at("proba", i + 1).alias(f"prob_{c}") for i, c in enumerate(names)]
    return scored.select(*cols)
