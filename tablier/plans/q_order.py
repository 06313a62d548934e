"""Splits whose keys are null or repeated, and strata by the thousand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_digest_sql
from ..operators import imbalance as H
from ..operators import preprocess as P
from ..operators import split as S
from ..sources.tables import table
from .registry import register

# a third of the keys is missing, the others occur up to four times; many rows are equal
_LOOSE = """SELECT CASE WHEN o_orderkey % 10 >= 3 THEN o_orderkey // 4 END AS k, o_orderstatus AS status FROM orders"""


def loose_orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.when(F.col("o_orderkey") % 10 >= 3, F.expr("o_orderkey div 4")).alias("k"), F.col("o_orderstatus").alias("status"))


def _counted(parts):
    return parts.groupBy(F.coalesce("k", F.lit(-1)).alias("k"), "status", "split").agg(F.count("*").alias("rows"))


def _seeded(seed: int, column: str) -> str:
    """The place of a key in the seeded order; a null key has one too."""
    return f"coalesce(md5('{seed}|' || CAST({column} AS VARCHAR)), md5('{seed}'))"


@register("split_random_nulls", f"""
WITH d AS ({_LOOSE}),
r AS (SELECT *, row_number() OVER (ORDER BY {_seeded(42, 'k')}, k, {row_digest_sql('k', 'status')}) AS rn, count(*) OVER () AS n FROM d)
SELECT coalesce(k, -1) AS k, status, CASE WHEN rn <= n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split, count(*) AS rows
FROM r GROUP BY ALL""")
def q_split_random_nulls(spark, sf):
    return _counted(S.split(loose_orders(spark, sf), "k", "random", 0.2, 42))


@register("split_stratified_nulls", f"""
WITH d AS ({_LOOSE}),
c AS (SELECT status, count(*) AS c FROM d GROUP BY 1),
t AS (SELECT sum(c) AS n, CAST(ceil(0.2::DOUBLE * sum(c)) AS BIGINT) AS m FROM c),
q AS (SELECT status, c, (m * c) // n + CASE WHEN row_number() OVER (ORDER BY (m * c) % n DESC, status) <= m - sum((m * c) // n) OVER () THEN 1 ELSE 0 END AS tq FROM c, t),
r AS (SELECT d.*, row_number() OVER (PARTITION BY status ORDER BY {_seeded(42, 'k')}, k, {row_digest_sql('k', 'status')}) AS rn FROM d)
SELECT coalesce(k, -1) AS k, status, CASE WHEN rn <= c - tq THEN 'train' ELSE 'test' END AS split, count(*) AS rows
FROM r JOIN q USING (status) GROUP BY ALL""")
def q_split_stratified_nulls(spark, sf):
    out = S.split(loose_orders(spark, sf), "k", "stratified", 0.2, 42, target="status")
    return _counted(out)


@register("split_three_way_nulls", f"""
WITH d AS ({_LOOSE}),
r AS (SELECT *, row_number() OVER (ORDER BY {_seeded(42, 'k')}, k, {row_digest_sql('k', 'status')}) AS rn, count(*) OVER () AS n FROM d),
rest AS (SELECT k, status FROM r WHERE rn <= n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT)),
v AS (SELECT *, row_number() OVER (ORDER BY {_seeded(43, 'k')}, k, {row_digest_sql('k', 'status')}) AS rn, count(*) OVER () AS n FROM rest),
u AS (SELECT k, status, 'test' AS split FROM r WHERE rn > n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT)
      UNION ALL SELECT k, status, CASE WHEN rn > n - CAST(ceil({10.0 / 80.0!r}::DOUBLE * n) AS BIGINT) THEN 'validation' ELSE 'train' END FROM v)
SELECT coalesce(k, -1) AS k, status, split, count(*) AS rows FROM u GROUP BY ALL""")
def q_split_three_way_nulls(spark, sf):
    out = S.split_three_way(loose_orders(spark, sf), "k", "random", 70, 10, 20, 42)
    return _counted(out)


@register("split_group_nulls", f"""
WITH d AS (SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id END AS g, conv_id, turn FROM conversations),
r AS (SELECT g, row_number() OVER (ORDER BY {_seeded(42, 'g')}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM d))
SELECT coalesce(d.g, -1) AS g, conv_id, turn, CASE WHEN rn <= n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM d JOIN r ON d.g IS NOT DISTINCT FROM r.g""")
def q_split_group_nulls(spark, sf):
    c = table(spark, sf, "conversations")
    df = c.select(F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("g"), "conv_id", "turn")
    return S.split(df, "turn", "group", 0.2, 42, group="g").withColumn("g", F.coalesce("g", F.lit(-1)))


# every order is a class: more classes than a driver should hold
_LINES = "(SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)"


def order_lines(spark, sf):
    """The lines of orders with two or more, each order a class."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    many = li.groupBy("l_orderkey").count().where("count > 1").select("l_orderkey")
    return li.join(many, "l_orderkey", "left_semi")


@register("split_stratified_many", f"""
WITH d AS (SELECT *, l_orderkey::VARCHAR AS g FROM {_LINES} WHERE c > 1),
c AS (SELECT g, any_value(c) AS c FROM d GROUP BY 1),
t AS (SELECT sum(c) AS n, CAST(ceil(0.5::DOUBLE * sum(c)) AS BIGINT) AS m FROM c),
q AS (SELECT g, c, (m * c) // n + CASE WHEN row_number() OVER (ORDER BY (m * c) % n DESC, g) <= m - sum((m * c) // n) OVER () THEN 1 ELSE 0 END AS tq FROM c, t),
r AS (SELECT d.*, row_number() OVER (PARTITION BY g ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_linenumber) AS rn FROM d)
SELECT l_orderkey, l_linenumber, CASE WHEN rn <= q.c - tq THEN 'train' ELSE 'test' END AS split FROM r JOIN q USING (g)""")
def q_split_stratified_many(spark, sf):
    return S.split(order_lines(spark, sf), ["l_orderkey", "l_linenumber"], "stratified", 0.5, 42, target="l_orderkey")


@register("undersample_many", f"""
SELECT l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_linenumber) AS rn,
         min(c) OVER () AS smallest FROM {_LINES} WHERE c > 1) WHERE rn <= smallest""")
def q_undersample_many(spark, sf):
    return H.undersample(order_lines(spark, sf), ["l_orderkey", "l_linenumber"], "l_orderkey")


_RANKS = "(SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT l_orderkey::VARCHAR AS v FROM lineitem WHERE l_orderkey % 10 < 9))"


@register("target_encode_many", f"""
SELECT l_orderkey, l_linenumber, i::DOUBLE AS label FROM lineitem JOIN {_RANKS} ON v = l_orderkey::VARCHAR""")
def q_target_encode_many(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    levels = P.level_table(li.where("l_orderkey % 10 < 9"), P.target_label("l_orderkey"))
    return P.encode_by_table(li, P.target_label("l_orderkey"), levels, "label").where("label IS NOT NULL")


@register("one_hot_many", f"""
SELECT l_orderkey, l_linenumber, i IS NOT NULL AS known, coalesce(i, -1) AS hot_index, (SELECT count(*) FROM {_RANKS}) AS size
FROM lineitem LEFT JOIN {_RANKS} ON v = l_orderkey::VARCHAR""")
def q_one_hot_many(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    levels = P.level_table(li.where("l_orderkey % 10 < 9"), P.target_label("l_orderkey"))
    hot = P.encode_sparse(li, "l_orderkey", levels, "hot")
    # a sparse vector as text is (size,[indices],[values])
    parts = F.regexp_extract(F.col("hot").cast("string"), r"\((\d+),\[(\d*)\]", 2)
    return hot.select(
        "l_orderkey", "l_linenumber", (parts != "").alias("known"), F.when(parts != "", parts.cast("long")).otherwise(-1).alias("hot_index"),
        F.regexp_extract(F.col("hot").cast("string"), r"\((\d+),", 1).cast("long").alias("size"),
    )
