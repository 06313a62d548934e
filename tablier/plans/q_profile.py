"""Profiling and missing-value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import (
    GATE_MISSING_MARKERS,
    LOADER_MISSING_MARKERS,
    gate_missing,
    norm_text_sql,
    normalize_missing,
    sql_in_list,
)
from ..operators import columns as C
from ..operators import profile as P
from ..sources.tables import table
from .registry import register

# ------------------------------------------------------------------ helpers


def _vc_sql(src: str, cols: list[tuple[str, str]]) -> str:
    """UNION ALL of per-column value counts; kinds: numeric/float/string/datetime."""
    parts = []
    for c, k in cols:
        v = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if k == "float" else c
        parts.append(f"SELECT '{c}' AS \"column\", CAST({v} AS VARCHAR) AS value, count(*) AS count FROM {src} GROUP BY 2")
    return "\nUNION ALL ".join(parts)


def _kind_case(cols) -> str:
    whens = " ".join(f"WHEN '{c}' THEN '{'numeric' if k == 'float' else k}'" for c, k in cols)
    return f'CASE "column" {whens} END'


def profile_sql(src: str, cols) -> str:
    return f"""
WITH vc AS ({_vc_sql(src, cols)}),
per AS (
  SELECT "column", sum(count) AS "rows",
         coalesce(sum(count) FILTER (WHERE value IS NULL), 0) AS missing_count,
         count(value) AS n_distinct,
         coalesce(sum(count) FILTER (WHERE value IS NOT NULL), 0) AS non_missing,
         bool_and(CASE WHEN value IS NOT NULL THEN TRY_CAST(value AS TIMESTAMP) IS NOT NULL END) AS all_ts,
         count(*) AS levels_with_null
  FROM vc GROUP BY "column"),
k AS (SELECT *, {_kind_case(cols)} AS kind FROM per),
d AS (SELECT *, (kind = 'datetime') OR (kind = 'string' AND non_missing > 0 AND coalesce(all_ts, false)) AS datetime_like FROM k)
SELECT "column", kind, "rows", missing_count,
       round(CASE WHEN "rows" > 0 THEN missing_count * 100.0 / "rows" ELSE 0.0 END, 6) AS missing_percent,
       n_distinct, non_missing, datetime_like,
       CASE WHEN datetime_like THEN 'Date/Time'
            WHEN kind = 'boolean' THEN 'Boolean'
            WHEN kind = 'numeric' THEN 'Numeric'
            WHEN kind = 'string' THEN CASE WHEN non_missing = 0 THEN 'Unknown'
                                           WHEN n_distinct / non_missing > 0.5 AND n_distinct > 20 THEN 'Text'
                                           ELSE 'Categorical' END
            ELSE 'Unknown' END AS simplified_type,
       levels_with_null <= 1 AS constant
FROM d"""


EVENTS_COLS = [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "string"),
               ("value", "float"), ("props", "string")]
ORDERS_COLS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "float"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")]

# A raw view of events carrying missing markers, derived from the data values
# (the shared tables have no missing values of their own).
DIRTY_EVENTS_SQL = """(SELECT event_id, ts, user_id,
  CASE WHEN value < 2 THEN ' NA ' WHEN value < 4 THEN 'None' WHEN value < 6 THEN '' WHEN value < 8 THEN 'nan'
       WHEN value < 9 THEN '""' WHEN value < 10 THEN E'n/a\\t' ELSE event_type END AS event_type,
  CASE WHEN value > 460 AND value <= 470 THEN 'NaN'::DOUBLE WHEN value > 470 THEN NULL ELSE value END AS value,
  CASE WHEN value > 480 THEN 'NULL' WHEN value > 475 THEN '  ' ELSE props END AS props
FROM events)"""


def dirty_events(spark, sf, keep_raw: bool = False):
    e = table(spark, sf, "events")
    v = F.col("value")
    et = (
        F.when(v < 2, " NA ").when(v < 4, "None").when(v < 6, "").when(v < 8, "nan")
        .when(v < 9, '""').when(v < 10, "n/a\t").otherwise(F.col("event_type"))
    )
    val = F.when((v > 460) & (v <= 470), F.lit(float("nan"))).when(v > 470, F.lit(None)).otherwise(v)
    pr = F.when(v > 480, "NULL").when(v > 475, "  ").otherwise(F.col("props"))
    extra = [v.alias("_raw")] if keep_raw else []
    return e.select("event_id", "ts", "user_id", et.alias("event_type"), val.alias("value"), pr.alias("props"), *extra)


# ------------------------------------------------------------------ B: profile


@register("profile_types", profile_sql("events", EVENTS_COLS))
def q_profile_types(spark, sf):
    return P.column_profile(table(spark, sf, "events"))


_LOADER = sql_in_list(LOADER_MISSING_MARKERS)
NORMALIZED_EVENTS_SQL = f"""(SELECT event_id, ts, user_id,
  CASE WHEN {norm_text_sql('event_type')} IN ({_LOADER}) THEN NULL ELSE event_type END AS event_type,
  CASE WHEN isnan(value) THEN NULL ELSE value END AS value,
  CASE WHEN {norm_text_sql('props')} IN ({_LOADER}) THEN NULL ELSE props END AS props
FROM {DIRTY_EVENTS_SQL})"""


@register("profile_missing", f"""
WITH p AS ({profile_sql(NORMALIZED_EVENTS_SQL, EVENTS_COLS)})
SELECT "column", missing_count, missing_percent FROM p""")
def q_profile_missing(spark, sf):
    df = normalize_missing(dirty_events(spark, sf))
    return P.column_profile(df).select("column", "missing_count", "missing_percent")


@register("profile_summary", f"""
WITH p AS ({profile_sql('orders', ORDERS_COLS)}),
dup AS (SELECT coalesce(sum(n - 1), 0) AS duplicate_rows FROM (SELECT count(*) AS n FROM orders
  GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)),
a AS (SELECT max("rows") AS "rows", sum(missing_count) AS total_missing_values,
             count(*) FILTER (WHERE kind = 'numeric') AS numeric_columns,
             count(*) FILTER (WHERE kind <> 'numeric' AND NOT datetime_like) AS categorical_columns,
             count(*) FILTER (WHERE datetime_like) AS datetime_like_columns FROM p)
SELECT "rows", 6 AS "columns", total_missing_values,
       round(CASE WHEN "rows" > 0 THEN total_missing_values * 100.0 / ("rows" * 6) ELSE 0.0 END, 6) AS total_missing_percent,
       duplicate_rows,
       round(CASE WHEN "rows" > 0 THEN duplicate_rows * 100.0 / "rows" ELSE 0.0 END, 6) AS duplicate_row_percent,
       numeric_columns, categorical_columns, datetime_like_columns,
       round(numeric_columns * 100.0 / 6, 6) AS numeric_percent,
       round(categorical_columns * 100.0 / 6, 6) AS categorical_percent
FROM a, dup""")
def q_profile_summary(spark, sf):
    return P.dataset_summary(table(spark, sf, "orders"))


@register("profile_duplicates", """
SELECT coalesce(sum(n), 0) AS "rows", coalesce(sum(n - 1), 0) AS duplicate_rows
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)""")
def q_profile_duplicates(spark, sf):
    return P.duplicate_rows(table(spark, sf, "documents"), ["text", "lang", "source"])


@register("profile_duplicate_ids", """
SELECT 'l_orderkey,l_linenumber' AS id_columns, coalesce(sum(n - 1), 0) AS duplicate_ids,
       round(CASE WHEN sum(n) > 0 THEN coalesce(sum(n - 1), 0) * 100.0 / sum(n) ELSE 0.0 END, 6) AS duplicate_id_percent
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def q_profile_duplicate_ids(spark, sf):
    return P.duplicate_ids(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("value_frequencies", """
WITH c AS (SELECT o_custkey AS value, count(*) AS count FROM orders GROUP BY 1)
SELECT value, count, round(count * 100.0 / sum(count) OVER (), 6) AS percent
FROM c ORDER BY count DESC, value ASC NULLS FIRST LIMIT 100""")
def q_value_frequencies(spark, sf):
    return P.value_frequencies(table(spark, sf, "orders"), "o_custkey", 100)


@register("encoding_metadata", """
SELECT 'source' AS "column", count(DISTINCT source) AS unique_count, count(*) FILTER (WHERE source IS NULL) AS missing_count,
       (SELECT list(v ORDER BY v) FROM (SELECT DISTINCT source AS v FROM documents WHERE source IS NOT NULL ORDER BY v LIMIT 100)) AS first_values
FROM documents""")
def q_encoding_metadata(spark, sf):
    return P.encoding_metadata(table(spark, sf, "documents"), "source")


@register("target_distribution", """
WITH c AS (SELECT CAST(o_orderpriority AS VARCHAR) AS class, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT class, count, round(count * 100.0 / sum(count) OVER (), 6) AS percent FROM c""")
def q_target_distribution(spark, sf):
    return P.target_distribution(table(spark, sf, "orders"), "o_orderpriority")


@register("target_cardinality", "SELECT count(DISTINCT event_type) AS n_classes FROM events")
def q_target_cardinality(spark, sf):
    return P.target_cardinality(table(spark, sf, "events"), "event_type")


@register("preview_page", """
SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, 'null') AS o_orderstatus, o_totalprice,
       coalesce(o_orderpriority, 'null') AS o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 150""")
def q_preview_page(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", P.display_value("o_orderstatus").alias("o_orderstatus"), "o_totalprice",
        P.display_value("o_orderpriority").alias("o_orderpriority"),
    )
    return P.preview_page(df, ["o_orderkey"], page=3, page_size=50)


# ------------------------------------------------------------------ C: missing values


@register("null_markers", f"""
SELECT 'event_type' AS "column", count(*) FILTER (WHERE event_type IS NULL) AS missing FROM {NORMALIZED_EVENTS_SQL}
UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL) FROM {NORMALIZED_EVENTS_SQL}
UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL) FROM {NORMALIZED_EVENTS_SQL}""")
def q_null_markers(spark, sf):
    df = normalize_missing(dirty_events(spark, sf))
    return C.missing_counts(df, ["event_type", "value", "props"], rule="null")


_GATE = sql_in_list(GATE_MISSING_MARKERS)


@register("missing_mask_counts", f"""
WITH d AS {DIRTY_EVENTS_SQL}
SELECT * FROM (
  SELECT 'event_type' AS "column", count(*) FILTER (WHERE event_type IS NULL OR {norm_text_sql('event_type')} IN ({_GATE})) AS missing,
         count(*) AS "rows" FROM d
  UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL OR isnan(value)), count(*) FROM d
  UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL OR {norm_text_sql('props')} IN ({_GATE})), count(*) FROM d)
WHERE missing > 0""")
def q_missing_mask_counts(spark, sf):
    df = dirty_events(spark, sf)
    return C.selected_missing_counts(df, ["event_type", "value"], "props")


# Fixed grouping used by the map_levels query (raw source -> group).
SOURCE_GROUPS = {
    "src0": "web", "src1": "web", "src2": "web", "src3": "web",
    "src4": "news", "src5": "news", "src6": "news",
    "src7": "forum", "src8": "forum", "src9": "forum",
    "src10": "books", "src11": "books",
}


def _groups_sql():
    rows = ", ".join(f"('{k}', '{v}')" for k, v in SOURCE_GROUPS.items())
    return f"(VALUES {rows}) AS m(raw, grp)"


@register("map_levels", f"""
SELECT coalesce(m.grp, 'Other') AS source_group, count(*) AS n
FROM documents d LEFT JOIN {_groups_sql()} ON d.source = m.raw GROUP BY 1""")
def q_map_levels(spark, sf):
    d = table(spark, sf, "documents").select("source")
    mapped = C.map_levels(spark, d, "source", SOURCE_GROUPS, "source_group", default="Other")
    return mapped.groupBy("source_group").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["gate_missing"]
