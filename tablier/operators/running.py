"""Running totals and neighbours in an order, without a window over a whole group.

``in_order`` is a distributed prefix sum. Rows are range-partitioned and sorted
by (keys, order) and written once with their place; a window then only ever
covers the share of a key within one of these ranges. Totals per key and range
are summed over the ranges (a small table, one row per key and range) and added
as offsets, and the values at the edges of a range come from the same table. A
key with most of the rows is spread over as many ranges as its rows fill.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

ROWS_PER_TASK = 20_000  # rows that one task may hold when others could share them
BYTES_PER_TASK = 256 << 20  # of rows that a task reads again and again
ROWS_PER_RANGE = 500_000  # rows of one range; at least spark.sql.shuffle.partitions ranges are made


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` of ``rows`` rows over all cores, and over more tasks where one would hold more than ``BYTES_PER_TASK``.

    Small files come back as one partition, however many rows they hold; few rows stay as they lie.
    """
    if rows <= ROWS_PER_TASK:
        return df
    cores = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return df.repartition(max(cores, -(-rows * row_bytes // BYTES_PER_TASK)))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_r_{k}"])
    return out


def in_order(df: DataFrame, keys: list[str], order: list[str], sums=(), before=(), after=(), rows_per_range: int | None = None) -> DataFrame:
    """``df`` with, per row and within its ``keys``:

    ``rank`` (from 1), ``<v>_below`` for v in ``sums`` (sum of v over earlier
    rows), ``<v>_lower`` for v in ``before`` and ``<v>_upper`` for v in ``after``
    (v of the row just before / after; null at the ends). Rows that tie in
    ``order`` follow in any order. ``df`` should be a written table.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows_per_range or ROWS_PER_RANGE)))
    by = [F.asc_nulls_first(c) for c in (*keys, *order)]
    placed = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "in-order").withColumn("_range", F.shiftright("_at", 33))

    edges = [F.min_by(F.struct(*after), "_at").alias("_first")] if after else []
    edges += [F.max_by(F.struct(*before), "_at").alias("_last")] if before else []
    per = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t_{v}") for v in sums], *edges)
    across = W.partitionBy(*keys).orderBy("_range")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col("_range").alias("_r_range"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in sums],
        *([F.lag("_last").over(across).alias("_before")] if before else []),
        *([F.lead("_first").over(across).alias("_after")] if after else []),
    )
    joined = placed.join(offsets, _same(placed, offsets, keys) & (placed["_range"] == offsets["_r_range"]))
    here = W.partitionBy(*keys, "_range").orderBy("_at")
    so_far = here.rowsBetween(W.unboundedPreceding, -1)
    return joined.select(
        *df.columns,
        (F.col("_o_n") + F.row_number().over(here)).alias("rank"),
        *[(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(so_far), F.lit(0))).alias(f"{v}_below") for v in sums],
        *[F.when(F.row_number().over(here) > 1, F.lag(v).over(here)).otherwise(F.col("_before")[v]).alias(f"{v}_lower") for v in before],
        *[F.when(F.lead("_at").over(here).isNotNull(), F.lead(v).over(here)).otherwise(F.col("_after")[v]).alias(f"{v}_upper") for v in after],
    )
