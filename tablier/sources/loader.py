"""Scans (A1-A5): load by extension, CSV encoding fallback, typed CSV, feather folders.

Everything is a distributed read; the only driver-side work is choosing the
reader and collecting one aggregate row of per-column type evidence.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import LOADER_MISSING_MARKERS, normalize_missing, norm_text

BOOL_TEXT = ["true", "false"]
# The texts of the errors.
UNSUPPORTED = "Unsupported dataset format '{extension}'. Supported formats: {known}."
ABSENT = "Dataset file does not exist: {path}"
FAILED = "Failed to load dataset '{path}': {reason}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def csv_file_kinds(spark: SparkSession, path: str) -> dict[tuple[bool, bool], list[str]]:
    """The CSV files by (records span lines, not UTF-8), from one splittable pass over their lines.

    A record spans lines exactly where a line holds an odd number of quotes.
    One row per file reaches the driver, which lists the files anyway.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    flags = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), (quotes % 2 == 1).alias("spans"), (~F.is_valid_utf8("value")).alias("other")
    )
    kinds: dict[tuple[bool, bool], list[str]] = {}
    for r in flags.groupBy("file").agg(F.max("spans").alias("spans"), F.max("other").alias("other")).collect():
        kinds.setdefault((r["spans"], r["other"]), []).append(r["file"])
    return kinds


def read_csv_text(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A2: all columns as text, a quote inside quotes is doubled; files that are not UTF-8 are read as Latin-1.

    Only files with records that span lines are read whole by a task, the others are split.
    """
    kinds = csv_file_kinds(spark, path)
    everything = spark.read.options(header="true", inferSchema="false", escape='"', mode="PERMISSIVE")
    if len(kinds) < 2:
        (spans, other), _ = next(iter(kinds.items()), ((False, False), []))
        return everything.options(multiLine=str(spans).lower(), encoding="ISO-8859-1" if other else "UTF-8").csv(path), "latin1" if other else "utf-8"
    out = None
    for (spans, other), files in sorted(kinds.items()):
        part = everything.options(multiLine=str(spans).lower(), encoding="ISO-8859-1" if other else "UTF-8").csv(sorted(files))
        out = part if out is None else out.unionByName(part)
    return out, "latin1" if any(other for _, other in kinds) else "utf-8"


def infer_types(df: DataFrame) -> dict[str, str]:
    """A3: one aggregate of parse evidence per column, with missing markers already NULL.

    bigint if every value parses as an integer, double if every value parses
    as a number (or the column is all missing), boolean for true/false text,
    string otherwise.
    """
    aggs = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        nn = col.isNotNull()
        aggs += [
            F.count(col).alias(f"n_{c}"),
            F.count_if(nn & col.try_cast("bigint").isNotNull() & ~col.contains(".")).alias(f"i_{c}"),
            F.count_if(nn & col.try_cast("double").isNotNull()).alias(f"d_{c}"),
            F.count_if(nn & F.lower(F.trim(col)).isin(BOOL_TEXT)).alias(f"b_{c}"),
        ]
    if not aggs:
        return {}
    r = df.agg(*aggs).collect()[0]
    out = {}
    for c in df.columns:
        n = r[f"n_{c}"]
        if n == 0:
            out[c] = "double"
        elif r[f"i_{c}"] == n:
            out[c] = "bigint"
        elif r[f"d_{c}"] == n:
            out[c] = "double"
        elif r[f"b_{c}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """A2 + A3 + C4: text read, markers -> NULL, then cast by the inferred types."""
    raw, _ = read_csv_text(spark, path)
    cols = []
    for f in raw.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.when(norm_text(c).isin(LOADER_MISSING_MARKERS), F.lit(None)).otherwise(c).alias(f.name))
    text = raw.select(*cols)
    types = infer_types(text)
    typed = []
    for c, t in types.items():
        col = F.col(f"`{c}`")
        if t == "boolean":
            typed.append((F.lower(F.trim(col)) == "true").alias(c))
        elif t == "string":
            typed.append(col.alias(c))
        else:
            typed.append(col.cast(t).alias(c))
    return text.select(*typed)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """A5: a feather file or a folder of them. Spark lists and reads the files, on any of its file systems;
    their record batches are decoded in the tasks, and the schema comes from the footer of one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path)

    def schemas(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_pydict({"schema": [pa.ipc.open_file(pa.BufferReader(content)).schema.serialize().to_pybytes()]})

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    from pyspark.sql.pandas.types import from_arrow_schema

    first = files.select("content").limit(1).mapInArrow(schemas, "schema binary").first()
    if first is None:
        raise ValueError(f"No feather files found at {path}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(first["schema"])), prefer_timestamp_ntz=True)
    return files.select("content").mapInArrow(rows, schema)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": read_csv_typed,
    ".feather": lambda spark, path: normalize_missing(read_feather(spark, path)),
    ".parquet": lambda spark, path: normalize_missing(spark.read.parquet(path)),
}


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A1: the reader of the path's extension; missing markers become null in every format."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = READERS.get(extension)
    if reader is None or not _exists(spark, path):
        text = ABSENT if reader else UNSUPPORTED
        raise ValueError(text.format(extension=extension, known=", ".join(sorted(READERS)), path=path))
    try:
        return reader(spark, path)
    except ValueError:
        raise
    except Exception as reason:  # noqa: BLE001  (whatever a reader meets names its file)
        raise ValueError(FAILED.format(path=path, reason=reason)) from reason
