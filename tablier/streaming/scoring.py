"""Streaming scoring (N2): fitted preprocessing + closed-form model on ``readStream``.

Both steps are stateless per row (pure projections), so the same
expressions run unchanged in Structured Streaming; no state store is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                max_files_per_trigger: int = 100) -> DataFrame:
    """The Parquet files of ``folder`` as a stream; ``glob`` picks names in it, of files or of folders of part files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if not glob:
        return reader.parquet(folder)
    named = f"{folder.rstrip('/')}/{glob}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(named)
    found = path.getFileSystem(conf).globStatus(path) or []
    if any(status.isDirectory() for status in found):
        return reader.parquet(named)
    return reader.option("pathGlobFilter", glob).parquet(folder)


def run_to_table(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Drain a bounded stream (availableNow) into a parquet table under the shared folder."""
    spark = stream.sparkSession
    tag = name or uuid.uuid4().hex
    out = scratch_path(spark, f"stream-out/{tag}-{uuid.uuid4().hex}")
    ckpt = scratch_path(spark, f"stream-ckpt/{tag}-{uuid.uuid4().hex}")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)
