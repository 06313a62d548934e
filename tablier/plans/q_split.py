"""Split, fold and coverage queries on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as S
from ..sources.tables import ORDERS_CUSTOMER_SQL, orders_customer, table
from .registry import register
from .sqlgen import (
    group_folds_ctes,
    group_holdout_ctes,
    md5_sql,
    random_holdout_ctes,
    stratified_holdout_ctes,
)

OC = ORDERS_CUSTOMER_SQL
VAL_FRACTION = 10.0 / (70.0 + 10.0)


def _label(is_test: str) -> str:
    return f"CASE WHEN {is_test} = 1 THEN 'test' ELSE 'train' END"


# ---------------------------------------------------------------- two-way
@register("split_random", f"""
WITH {random_holdout_ctes('h', OC, 'o_orderkey', 0.2, 42)}
SELECT o_orderkey, {_label('is_test')} AS split FROM h""")
def q_split_random(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey")
    return S.split(df, "o_orderkey", "random", 0.2, 42).select("o_orderkey", "split")


@register("split_stratified", f"""
WITH {stratified_holdout_ctes('h', OC, 'o_orderkey', 'o_orderstatus', 0.2, 42)}
SELECT o_orderkey, {_label('is_test')} AS split FROM h""")
def q_split_stratified(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus")
    return S.split(df, "o_orderkey", "stratified", 0.2, 42, target="o_orderstatus").select("o_orderkey", "split")


@register("split_group", f"""
WITH {group_holdout_ctes('h', OC, 'o_custkey', 0.2, 42)}
SELECT o.o_orderkey, {_label('h.is_test')} AS split FROM {OC} o JOIN h ON o.o_custkey = h.o_custkey""")
def q_split_group(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_custkey")
    return S.split(df, "o_orderkey", "group", 0.2, 42, group="o_custkey").select("o_orderkey", "split")


@register("split_stratified_group", f"""
WITH {group_folds_ctes('f', OC, 'o_custkey', 'o_orderstatus', 5, 42)}
SELECT o.o_orderkey, CASE WHEN f.fold = 0 THEN 'test' ELSE 'train' END AS split
FROM {OC} o JOIN f ON o.o_custkey = f.o_custkey""")
def q_split_stratified_group(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus")
    out = S.split(df, "o_orderkey", "stratified_group", 0.2, 42, target="o_orderstatus", group="o_custkey")
    return out.select("o_orderkey", "split")


@register("split_time", """
WITH t AS (SELECT count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT)) AS m FROM events),
r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, CASE WHEN rn > n - m THEN 'test' ELSE 'train' END AS split FROM r, t""")
def q_split_time(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts")
    return S.split(df, "event_id", "time", 0.2, 42, date="ts").select("event_id", "split")


# ---------------------------------------------------------------- three-way
THREE_WAY_SQL = f"""
WITH {stratified_holdout_ctes('h1', OC, 'o_orderkey', 'o_orderstatus', 0.2, 42)},
rest AS (SELECT o.* FROM {OC} o JOIN h1 ON o.o_orderkey = h1.o_orderkey WHERE h1.is_test = 0),
{stratified_holdout_ctes('h2', 'rest', 'o_orderkey', 'o_orderstatus', VAL_FRACTION, 43)},
sp AS (
  SELECT o.o_orderkey, o.o_orderstatus,
         CASE WHEN h1.is_test = 1 THEN 'test' WHEN h2.is_test = 1 THEN 'validation' ELSE 'train' END AS split
  FROM {OC} o JOIN h1 ON o.o_orderkey = h1.o_orderkey LEFT JOIN h2 ON o.o_orderkey = h2.o_orderkey)"""


def three_way_orders(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus")
    return S.split_three_way(df, "o_orderkey", "stratified", 70, 10, 20, 42, target="o_orderstatus")


@register("split_three_way", THREE_WAY_SQL + "\nSELECT o_orderkey, split FROM sp")
def q_split_three_way(spark, sf):
    return three_way_orders(spark, sf).select("o_orderkey", "split")


COVERAGE_SELECT = """
SELECT CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS full_count,
       count(*) FILTER (WHERE split = 'train') AS train_count,
       count(*) FILTER (WHERE split = 'validation') AS validation_count,
       count(*) FILTER (WHERE split = 'test') AS test_count
FROM sp WHERE o_orderstatus IS NOT NULL GROUP BY 1"""


def _status_sql(prefix: str = "") -> str:
    tr, va, te = f"{prefix}train_count", f"{prefix}validation_count", f"{prefix}test_count"
    return f"""coalesce(nullif(concat_ws('; ',
          CASE WHEN {tr} = 0 THEN '{S.STATUS_MISSING_TRAIN}' END,
          CASE WHEN {tr} > 0 AND {va} = 0 THEN '{S.STATUS_MISSING_VALIDATION}' END,
          CASE WHEN {tr} > 0 AND {te} = 0 THEN '{S.STATUS_MISSING_TEST}' END), ''), 'OK')"""


@register("class_coverage", THREE_WAY_SQL + f""",
cov AS ({COVERAGE_SELECT})
SELECT *, {_status_sql()} AS status FROM cov""")
def q_class_coverage(spark, sf):
    return S.class_coverage(three_way_orders(spark, sf), "o_orderstatus")


# coverage issues need a split that actually loses classes: a time split of
# orders by date puts the newest status only in the later parts.
TIME3_SQL = f"""
WITH n AS (SELECT count(*) AS n FROM {OC}),
t1 AS (SELECT greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)) AS m FROM n),
r1 AS (SELECT o.o_orderkey, o.o_orderdate, o.o_orderpriority,
              row_number() OVER (ORDER BY o.o_orderdate, o.o_orderkey) AS rn FROM {OC} o),
rest AS (SELECT r1.* FROM r1, n, t1 WHERE rn <= n.n - t1.m),
t2 AS (SELECT count(*) AS n2, greatest(1, CAST(round_even(count(*) * {VAL_FRACTION!r}::DOUBLE, 0) AS BIGINT)) AS m2 FROM rest),
r2 AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn2 FROM rest),
sp AS (
  SELECT r1.o_orderkey, r1.o_orderpriority,
         CASE WHEN r1.rn > n.n - t1.m THEN 'test' WHEN r2.rn2 > t2.n2 - t2.m2 THEN 'validation' ELSE 'train' END AS split
  FROM r1 CROSS JOIN n CROSS JOIN t1 CROSS JOIN t2 LEFT JOIN r2 ON r1.o_orderkey = r2.o_orderkey),
cov AS (
  SELECT CAST(o_orderpriority AS VARCHAR) AS class, count(*) AS full_count,
         count(*) FILTER (WHERE split = 'train') AS train_count,
         count(*) FILTER (WHERE split = 'validation') AS validation_count,
         count(*) FILTER (WHERE split = 'test') AS test_count
  FROM sp WHERE o_orderpriority IS NOT NULL GROUP BY 1)"""


def time_three_way_orders(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderdate", "o_orderpriority")
    return S.split_three_way(df, "o_orderkey", "time", 70, 10, 20, 42, date="o_orderdate")


GROUP3_SQL = f"""
WITH {group_holdout_ctes('h1', 'conversations', 'conv_id', 0.2, 42)},
rest AS (SELECT c.* FROM conversations c JOIN h1 ON c.conv_id = h1.conv_id WHERE h1.is_test = 0),
{group_holdout_ctes('h2', 'rest', 'conv_id', VAL_FRACTION, 43)},
sp AS (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN h1.is_test = 1 THEN 'test' WHEN h2.is_test = 1 THEN 'validation' ELSE 'train' END AS split
  FROM conversations c JOIN h1 ON c.conv_id = h1.conv_id LEFT JOIN h2 ON c.conv_id = h2.conv_id),
cov AS (
  SELECT CAST(role AS VARCHAR) AS class, count(*) AS full_count,
         count(*) FILTER (WHERE split = 'train') AS train_count,
         count(*) FILTER (WHERE split = 'validation') AS validation_count,
         count(*) FILTER (WHERE split = 'test') AS test_count
  FROM sp WHERE role IS NOT NULL GROUP BY 1)"""


def group_three_way_conversations(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return S.split_three_way(df, "turn", "group", 70, 10, 20, 42, group="conv_id")


@register("class_coverage_group", GROUP3_SQL + f"""
SELECT *, {_status_sql()} AS status FROM cov""")
def q_class_coverage_group(spark, sf):
    return S.class_coverage(group_three_way_conversations(spark, sf), "role")


@register("coverage_issues", GROUP3_SQL + f"""
SELECT level, 'split' AS category, message, '{S.CLASS_COVERAGE_FIX}' AS suggestion, class AS affected_column FROM (
  SELECT class, 'fatal' AS level,
         CASE WHEN validation_count > 0 OR test_count > 0
              THEN 'Class ''' || class || ''' appears in validation/test but not training. The model cannot predict this class.'
              ELSE 'Class ''' || class || ''' is absent from the training set. The model cannot learn this class.' END AS message
  FROM cov WHERE train_count = 0
  UNION ALL
  SELECT class, 'warning', 'Class ''' || class || ''' is absent from the validation set. Validation metrics for this class may be unavailable.'
  FROM cov WHERE train_count > 0 AND validation_count = 0
  UNION ALL
  SELECT class, 'warning', 'Class ''' || class || ''' is absent from the test set. Test metrics for this class may be unavailable.'
  FROM cov WHERE train_count > 0 AND test_count = 0) x""")
def q_coverage_issues(spark, sf):
    return S.coverage_issues(S.class_coverage(group_three_way_conversations(spark, sf), "role"))


@register("class_coverage_time", TIME3_SQL + f"""
SELECT *, {_status_sql()} AS status FROM cov""")
def q_class_coverage_time(spark, sf):
    return S.class_coverage(time_three_way_orders(spark, sf), "o_orderpriority")


@register("class_distribution", THREE_WAY_SQL + """,
c AS (SELECT split, coalesce(CAST(o_orderstatus AS VARCHAR), 'null') AS class, count(*) AS count FROM sp GROUP BY 1, 2)
SELECT split, class, count, round(count * 100.0 / sum(count) OVER (PARTITION BY split), 6) AS percent FROM c""")
def q_class_distribution(spark, sf):
    return S.class_distribution(three_way_orders(spark, sf), "o_orderstatus")


@register("cv_feasibility", """
SELECT coalesce(CAST(lang AS VARCHAR), 'null') AS class, count(*) AS n, 400 AS folds
FROM documents GROUP BY 1 HAVING count(*) < 400""")
def q_cv_feasibility(spark, sf):
    return S.cv_feasibility(table(spark, sf, "documents").select("lang"), "lang", 400)


# ---------------------------------------------------------------- out of time / folds / samples
@register("split_oot", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) IN (2000) THEN 'test' ELSE 'train' END AS split
FROM orders WHERE year(o_orderdate) IN (1998, 1999, 2000)""")
def q_split_oot(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return S.split_out_of_time(df, "o_orderdate", [1998, 1999], [2000]).select("o_orderkey", "split")


@register("kfold_stratified", f"""
SELECT event_id, CAST((row_number() OVER (PARTITION BY CAST(event_type AS VARCHAR)
        ORDER BY {md5_sql(42, 'event_id')}, event_id) - 1) % 5 AS INTEGER) AS fold
FROM events""")
def q_kfold_stratified(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return S.kfold_stratified(df, "event_id", "event_type", 5, 42).select("event_id", "fold")


@register("kfold_group", f"""
WITH {group_folds_ctes('f', 'events', 'user_id', 'event_type', 5, 42)}
SELECT e.event_id, f.fold FROM events e JOIN f ON e.user_id = f.user_id""")
def q_kfold_group(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return S.kfold_group(df, "event_type", "user_id", 5, 42).select("event_id", "fold")


@register("learning_curve_sample", f"""
WITH g AS (SELECT DISTINCT conv_id FROM conversations),
t AS (SELECT greatest(1, CAST(floor(count(*) * 0.3::DOUBLE) AS BIGINT)) AS keep FROM g),
r AS (SELECT conv_id, row_number() OVER (ORDER BY {md5_sql(42, 'conv_id')}, conv_id) AS rn FROM g)
SELECT c.conv_id, c.turn FROM conversations c JOIN r ON c.conv_id = r.conv_id, t WHERE r.rn <= t.keep""")
def q_learning_curve_sample(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn")
    return S.learning_curve_sample(df, "conv_id", 0.3, 42)
