"""Sinks (A6-A15): every artifact is a Spark write; metadata rows are one-row frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_modeling_subset(df: DataFrame, features: list[str], target: str, path: str, fmt: str = "parquet") -> None:
    """Features then target, in that order."""
    df.select(*features, target).write.mode("overwrite").format(fmt).option("header", "true").save(path)


def write_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One table, partitioned by split (keys, features, label, original label, synthetic flag)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """One-row JSON document (target, task, split info, imbalance info)."""
    row = spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "doc string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()
    return json.loads(rows[0]["value"]) if rows else {}


def load_saved_split(spark: SparkSession, path: str, meta_path: str, target: str,
                     split_col: str = "split", label_col: str = "label") -> DataFrame:
    """Saved split with its consistency rules.

    All parts present, labels present for every row, saved target equals the
    configured target; one ``groupBy(split)`` aggregate does the row checks.
    """
    meta = read_metadata(spark, meta_path)
    if meta.get("target_column") != target:
        raise ValueError(
            f"Saved split was created for target '{meta.get('target_column')}', not '{target}'. Confirm the split again."
        )
    df = spark.read.parquet(path)
    stats = {
        r[split_col]: r for r in df.groupBy(split_col).agg(
            F.count(F.lit(1)).alias("rows"), F.count(label_col).alias("labels")
        ).collect()
    }
    missing = [p for p in ("train", "validation", "test") if p not in stats and p in meta.get("parts", ["train", "test"])]
    if missing:
        raise ValueError(f"Saved split is missing parts: {missing}.")
    for part, r in stats.items():
        if r["rows"] != r["labels"]:
            raise ValueError(f"Saved {part} part has {r['rows']} rows but {r['labels']} labels.")
    return df


def write_evaluation(df: DataFrame, path: str, partition_cols=("model", "split")) -> None:
    """Predictions, probabilities, reports, partitioned by model and split."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)


def write_results_csv(df: DataFrame, path: str) -> None:
    """One row per model with header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_model_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Read every model's metrics JSON back; ``status`` from a failure field."""
    df = spark.read.option("multiLine", "true").json(pattern).withColumn("source_file", F.input_file_name())
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("trained") if "error" in df.columns else F.lit("trained")
    return df.withColumn("status", status)


def write_params(df: DataFrame, path: str) -> None:
    """Fitted parameters or class mapping as Parquet."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


FEATHER_BATCHES = 32  # Arrow batches of one feather file


def write_feather_parts(df: DataFrame, folder: str) -> DataFrame:
    """Write every partition as feather files of bounded size; returns (path, rows) per file.

    A file is named by its partition and place, so a task that runs again
    writes the same files.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(df.schema)
    target = folder.rstrip("/")

    def write(batches):
        import itertools

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        filesystem, base = fs.FileSystem.from_uri(target if "://" in target else "file://" + target.removeprefix("file:"))
        filesystem.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        for block in itertools.count():
            some = list(itertools.islice(batches, FEATHER_BATCHES))
            if not some:
                return
            name = f"{base}/part-{part:05d}-{block:05d}.feather"
            with filesystem.open_output_stream(name) as f, pa.ipc.new_file(f, arrow_schema) as out:
                for batch in some:
                    out.write_batch(batch.cast(arrow_schema))
            yield pa.RecordBatch.from_pydict({"path": [name], "rows": [sum(b.num_rows for b in some)]})

    return df.mapInArrow(write, "path string, rows long")
