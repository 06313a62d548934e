"""Saved model outputs and the reports made from them.

Every output is a table partitioned by model and split, so a report on one
model reads one partition and a table over all models is one aggregate.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import evaluate as E
from .preprocess import Preprocessor
from .running import written

# The columns of the results table and the splits in their order.
SPLITS = ("train", "validation", "test")
RESULT_COLUMNS = (
    "model", "status", "train_accuracy", "train_macro_f1", "validation_accuracy", "validation_macro_f1", "test_accuracy", "test_macro_f1",
    "cv_accuracy_mean", "cv_accuracy_std", "cv_macro_f1_mean", "cv_macro_f1_std", "roc_auc", "saved",
)
OUTPUTS = ("predictions", "confusion", "report", "metrics", "misclassified")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def write_outputs(scored: DataFrame, base: str, model: str, split: str, classes: list[str]) -> None:
    """A10: predictions, confusion, report, metrics and misclassified rows of one model on one split.

    ``scored`` has actual, predicted and a ``prob_<class>`` per class beside its keys.
    """
    scored = written(scored, "scored")
    probabilities = [f"prob_{c}" for c in classes]
    cells = E.observed_cells(scored, "actual", "predicted")
    counts = E.score_counts(scored, "actual", classes, probabilities, positive_only=True)
    made = {
        "predictions": scored,
        "confusion": E.confusion(scored, "actual", "predicted", classes),
        "report": E.classification_report(cells),
        "metrics": E.classification_metrics(cells).crossJoin(E.roc_auc(counts)),
        "misclassified": E.misclassified(scored, "actual", "predicted", probabilities),
    }
    for name, table in made.items():
        # one folder per model and split: writing it again replaces it alone
        table.write.mode("overwrite").parquet(f"{base}/{name}/model={model}/split={split}")


def performance_table(spark: SparkSession, base: str, runs: list[tuple[str, str, bool]], cv: DataFrame | None = None) -> DataFrame:
    """One row per model of ``runs`` (model, status, saved) with all 14 columns; what was not measured is null."""
    out = spark.createDataFrame(runs, "model string, status string, saved boolean")
    metrics = _read(spark, f"{base}/metrics")
    if metrics is not None:
        cells = [F.struct("accuracy", "macro_f1", "roc_auc").alias("m")]
        wide = metrics.groupBy("model").pivot("split", list(SPLITS)).agg(F.first(cells[0]))
        flat = [F.col(s)[m].alias(f"{s}_{m}") for s in SPLITS for m in ("accuracy", "macro_f1")]
        out = out.join(wide.select(F.col("model"), *flat, F.col("test")["roc_auc"].alias("roc_auc")), "model", "left")
    if cv is not None:
        two = cv.where(F.col("metric").isin("accuracy", "macro_f1")).groupBy("model").pivot("metric", ["accuracy", "macro_f1"])
        named = two.agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
        out = out.join(named.select("model", *[F.col(f"{m}_{s}").alias(f"cv_{m}_{s}") for m in ("accuracy", "macro_f1") for s in ("mean", "std")]), "model", "left")
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in RESULT_COLUMNS])


def diagnostic(spark: SparkSession, base: str, model: str, split: str) -> tuple[DataFrame | None, list[str]]:
    """The confusion of a model on a split, rebuilt from the predictions where it was not saved, and warnings."""
    found = {name: _read(spark, f"{base}/{name}/model={model}/split={split}") for name in OUTPUTS}
    warnings = [f"Saved {name} of model '{model}' on split '{split}' are missing." for name in OUTPUTS if found[name] is None]
    if found["confusion"] is not None:
        return found["confusion"], warnings
    rows = found["predictions"]
    return (E.confusion(rows, "actual", "predicted") if rows is not None else None), warnings


def final_summary(spark: SparkSession, base: str, classes: list[str], cv: DataFrame) -> DataFrame:
    """CV and test macro-F1, F1 and recall per class, rounded to 4, by test macro-F1."""
    report = spark.read.parquet(f"{base}/report").where("split = 'test'")
    per_class = report.groupBy("model").agg(
        *[F.round(F.max(F.when(F.col("class") == c, F.col(m))), 4).alias(f"{m}_{c}") for c in classes for m in ("f1", "recall")]
    )
    test = spark.read.parquet(f"{base}/metrics").where("split = 'test'").select("model", F.round("macro_f1", 4).alias("test_macro_f1"))
    crossed = cv.where("metric = 'macro_f1'").select("model", F.round("mean", 4).alias("cv_macro_f1_mean"), F.round("std", 4).alias("cv_macro_f1_std"))
    return test.join(crossed, "model", "left").join(per_class, "model", "left").orderBy(F.desc("test_macro_f1"), "model")


# ------------------------------------------------------------------ fitted preprocessing (A13), calibrated scores


def save_preprocessor(spark: SparkSession, fitted: Preprocessor, path: str) -> None:
    spark.createDataFrame([(fitted.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_preprocessor(spark: SparkSession, path: str) -> Preprocessor:
    """The saved state, refused when it is not that of a preprocessor."""
    rows = spark.read.text(path).limit(2).collect()
    try:
        if len(rows) != 1:
            raise ValueError(f"{len(rows)} documents")
        return Preprocessor.from_json(rows[0]["value"])
    except (ValueError, TypeError) as reason:
        raise ValueError(f"Saved preprocessing artifacts have an unexpected format: {reason}") from reason


def save_calibrated(predictions: DataFrame, thresholds: DataFrame, base: str) -> None:
    """Calibrated predictions by model, thresholds by model and class, and a manifest of both.

    ``predictions`` has model, actual and predicted, ``thresholds`` model, class and threshold.
    """
    spark = predictions.sparkSession
    predictions.write.mode("overwrite").partitionBy("model").parquet(f"{base}/predictions")
    thresholds.write.mode("overwrite").parquet(f"{base}/thresholds")
    scores = {}
    for model in sorted(r["model"] for r in thresholds.select("model").distinct().collect()):
        rows = spark.read.parquet(f"{base}/predictions").where(F.col("model") == model)
        scores[model] = E.classification_metrics(E.observed_cells(rows, "actual", "predicted")).first()["macro_f1"]
    cuts: dict[str, dict[str, float]] = {m: {} for m in scores}
    for r in thresholds.collect():
        cuts[r["model"]][r["class"]] = r["threshold"]
    manifest = {"models": sorted(scores), "thresholds": cuts, "macro_f1": scores, "best_model": min(scores, key=lambda m: (-scores[m], m))}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/manifest")


def load_manifest(spark: SparkSession, base: str) -> dict:
    return json.loads(spark.read.text(f"{base}/manifest").first()["value"])


def new_base(spark: SparkSession) -> str:
    return scratch_path(spark, f"outputs-{uuid.uuid4().hex}")
