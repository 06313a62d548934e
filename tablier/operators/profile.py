"""Profiling: the one-pass "summary" query and value previews.

Wide statistics are computed by one unpivot to (column, level, evidence): the
level is a 128-bit hash of the value and the evidence a few bits about it
(missing, parses as a number or time, infinite), both taken where the row is
read. One ``groupBy(column, level, evidence).count()`` then gives every
per-column statistic, and shuffles a fixed 28 bytes per distinct value however
long the texts are. Duplicate rows are counted over 128-bit row hashes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from ..functions.missing import GATE_MISSING_MARKERS, WHITESPACE, is_float

PREVIEW_MAX_PAGE = 200
TOP_VALUES = 100


def kind_of(dtype) -> str:
    """Column kind used by the summary rules (booleans are not numeric here)."""
    if isinstance(dtype, BooleanType):
        return "boolean"
    if isinstance(dtype, NumericType):
        return "numeric"
    if isinstance(dtype, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    if isinstance(dtype, StringType):
        return "string"
    return "other"


def _value_as_string(f) -> Column:
    c = F.col(f"`{f.name}`")
    if is_float(f.dataType):
        c = F.nanvl(c, F.lit(None).cast(f.dataType))
        c = F.when(c == 0, F.lit(0).cast(f.dataType)).otherwise(c)  # -0.0 and 0.0 are one value
    return c.cast("string")


def column_value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) over all rows; value is the string form, NULL kept."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(f.name).alias("column"), _value_as_string(f).alias("value")) for f in fields])
        ).alias("cv")
    ).select("cv.column", "cv.value")
    return stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


#: Evidence bits of a value.
NULL, GATE_MISSING, NUMBER, TIME, INFINITE = 1, 2, 4, 8, 16


def _hash128(*columns: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds; equal for equal values, nulls in their places included."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *marked).alias(f"_h{seed}") for seed in (1, 2)]


def _evidence(f, value: Column) -> Column:
    bits = F.when(value.isNull(), F.lit(NULL)).otherwise(F.lit(0))
    missing = F.lit(False)
    if isinstance(f.dataType, StringType):
        missing = F.coalesce(F.lower(F.btrim(value, F.lit(WHITESPACE))).isin(GATE_MISSING_MARKERS), F.lit(False))
        bits = bits + F.when(value.try_cast("double").isNotNull(), F.lit(NUMBER)).otherwise(F.lit(0))
        bits = bits + F.when(F.try_to_timestamp(value).isNotNull(), F.lit(TIME)).otherwise(F.lit(0))
    elif is_float(f.dataType):
        bits = bits + F.when(value.isin("Infinity", "-Infinity"), F.lit(INFINITE)).otherwise(F.lit(0))
    return bits + F.when(value.isNull() | missing, F.lit(GATE_MISSING)).otherwise(F.lit(0))


def column_levels(df: DataFrame) -> DataFrame:
    """(position, evidence, count) per column and distinct value."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        value = _value_as_string(f)
        cells.append(F.struct(F.lit(i).alias("position"), *_hash128(value), _evidence(f, value).alias("evidence")))
    stacked = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return stacked.groupBy("position", "_h1", "_h2", "evidence").agg(F.count(F.lit(1)).alias("count")).drop("_h1", "_h2")


def column_statistics(df: DataFrame) -> DataFrame:
    """One row per column (none for an empty table): counts of rows, levels and evidence.

    columns: position, rows, levels (null is one), n_distinct, non_missing,
    gate_missing, min_level, numbers, times, infinite.
    """
    has = lambda bit: F.col("evidence").bitwiseAND(F.lit(bit)) != 0
    rows_with = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    return column_levels(df).groupBy("position").agg(
        F.sum("count").alias("rows"),
        F.count(F.lit(1)).alias("levels"),
        F.count_if(~has(NULL)).alias("n_distinct"),
        rows_with(~has(NULL)).alias("non_missing"),
        rows_with(has(GATE_MISSING)).alias("gate_missing"),
        F.min(F.when(~has(NULL), F.col("count"))).alias("min_level"),
        rows_with(has(NUMBER)).alias("numbers"),
        rows_with(has(TIME)).alias("times"),
        rows_with(has(INFINITE)).alias("infinite"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column.

    columns: column, kind, rows, missing_count, missing_percent, n_distinct,
    non_missing, datetime_like, simplified_type, constant.
    """
    by_position = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("position") + 1)
    per = column_statistics(df)
    kind = by_position([kind_of(f.dataType) for f in df.schema.fields])
    nd, nm = F.col("n_distinct"), F.col("non_missing")
    dt_like = (kind == "datetime") | ((kind == "string") & (nm > 0) & (F.col("times") == nm))
    simplified = (
        F.when(dt_like, "Date/Time")
        .when(kind == "boolean", "Boolean")
        .when(kind == "numeric", "Numeric")
        .when(kind == "string", F.when(nm == 0, "Unknown").when((nd / nm > 0.5) & (nd > 20), "Text").otherwise("Categorical"))
        .otherwise("Unknown")
    )
    missing = F.col("rows") - nm
    return per.select(
        by_position(df.columns).alias("column"),
        kind.alias("kind"),
        "rows",
        missing.alias("missing_count"),
        F.round(F.when(F.col("rows") > 0, missing * 100.0 / F.col("rows")).otherwise(0.0), 6).alias("missing_percent"),
        "n_distinct",
        "non_missing",
        dt_like.alias("datetime_like"),
        simplified.alias("simplified_type"),
        (F.col("levels") <= 1).alias("constant"),
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """One-row summary."""
    prof = column_profile(df)
    n_cols = len(df.columns)
    dup = duplicate_rows(df)
    agg = prof.agg(
        F.max("rows").alias("rows"),
        F.sum("missing_count").alias("total_missing_values"),
        F.count_if(F.col("kind") == "numeric").alias("numeric_columns"),
        F.count_if((F.col("kind") != "numeric") & ~F.col("datetime_like")).alias("categorical_columns"),
        F.count_if(F.col("datetime_like")).alias("datetime_like_columns"),
    )
    cells = F.col("rows") * F.lit(n_cols)
    return agg.crossJoin(dup.select("duplicate_rows")).select(
        "rows",
        F.lit(n_cols).alias("columns"),
        "total_missing_values",
        F.round(F.when(cells > 0, F.col("total_missing_values") * 100.0 / cells).otherwise(0.0), 6).alias("total_missing_percent"),
        "duplicate_rows",
        F.round(F.when(F.col("rows") > 0, F.col("duplicate_rows") * 100.0 / F.col("rows")).otherwise(0.0), 6).alias("duplicate_row_percent"),
        "numeric_columns",
        "categorical_columns",
        "datetime_like_columns",
        F.round(F.col("numeric_columns") * 100.0 / F.lit(max(n_cols, 1)), 6).alias("numeric_percent"),
        F.round(F.col("categorical_columns") * 100.0 / F.lit(max(n_cols, 1)), 6).alias("categorical_percent"),
    )


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first copy (NULL equals NULL).  One row."""
    fields = {f.name: f for f in df.schema.fields}

    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        if not is_float(fields[name].dataType):
            return c
        c = F.nanvl(c, F.lit(None).cast(fields[name].dataType))
        return F.when(c == 0, F.lit(0).cast(fields[name].dataType)).otherwise(c)

    groups = df.select(*_hash128(*[value(c) for c in columns or df.columns])).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_ids(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """Duplicate rows over the configured id columns, count and percent."""
    d = duplicate_rows(df, id_columns)
    return d.select(
        F.lit(",".join(id_columns)).alias("id_columns"),
        F.col("duplicate_rows").alias("duplicate_ids"),
        F.round(F.when(F.col("rows") > 0, F.col("duplicate_rows") * 100.0 / F.col("rows")).otherwise(0.0), 6).alias("duplicate_id_percent"),
    )


def value_frequencies(df: DataFrame, column: str, top: int = TOP_VALUES) -> DataFrame:
    """Top values by count, missing included, percent of all rows."""
    c = F.col(f"`{column}`")
    counts = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top_rows = counts.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(top)
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one scalar, not a window over all values
    return top_rows.crossJoin(F.broadcast(total)).select(
        "value", "count", F.round(F.col("count") * 100.0 / F.col("_total"), 6).alias("percent"))


def encoding_metadata(df: DataFrame, column: str, first: int = TOP_VALUES) -> DataFrame:
    """unique_count, missing_count and the first distinct values (sorted)."""
    c = F.col(f"`{column}`")
    vals = df.select(c.alias("v")).where(F.col("v").isNotNull()).distinct()
    stats = df.agg(F.count_distinct(c).alias("unique_count"), F.count_if(c.isNull()).alias("missing_count"))
    firsts = vals.orderBy("v").limit(first).agg(F.sort_array(F.collect_list(F.col("v").cast("string"))).alias("first_values"))
    return stats.crossJoin(firsts).select(F.lit(column).alias("column"), "unique_count", "missing_count", "first_values")


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Non-missing target counts and percent of non-missing rows."""
    c = F.col(f"`{target}`")
    counts = df.where(c.isNotNull()).groupBy(c.cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = df.where(c.isNotNull()).agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "class", "count", F.round(F.col("count") * 100.0 / F.col("_total"), 6).alias("percent"))


def target_cardinality(df: DataFrame, target: str) -> DataFrame:
    """B17."""
    return df.agg(F.count_distinct(F.col(f"`{target}`")).alias("n_classes"))


def display_value(c) -> Column:
    """Missing shown as 'null'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("null"))


def preview_page(df: DataFrame, key: list[str], page: int, page_size: int) -> DataFrame:
    """Page size clamped to 1..200, rows [start, end) in key order.

    Sort + offset/limit is planned as TakeOrderedAndProject: each partition
    keeps its best ``start+size`` rows only.
    """
    size = max(1, min(PREVIEW_MAX_PAGE, int(page_size)))
    start = max(0, int(page)) * size
    return df.orderBy(*key).offset(start).limit(size)


def page_count(n_rows: int, page_size: int) -> int:
    size = max(1, min(PREVIEW_MAX_PAGE, int(page_size)))
    return max(1, -(-n_rows // size))
