"""Preprocessing and rebalancing queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import imbalance as H
from ..operators import preprocess as P
from ..sources.tables import LABELS_DOCUMENTS_SQL, ORDERS_CUSTOMER_SQL, labels_documents, orders_customer, table
from .q_profile import DIRTY_EVENTS_SQL, dirty_events
from .registry import register
from .sqlgen import md5_sql

LD = LABELS_DOCUMENTS_SQL
OC = ORDERS_CUSTOMER_SQL

# ---------------------------------------------------------------- H: rebalancing


@register("class_weights", f"""
WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS count FROM {LD} GROUP BY 1)
SELECT class, count, round(sum(count) OVER () / (count(*) OVER () * count), 9) AS weight FROM c""")
def q_class_weights(spark, sf):
    w = H.class_weights_frame(labels_documents(spark, sf), "toxic")
    return w.withColumn("weight", F.round("weight", 9))


@register("positive_class_weight", f"""
SELECT greatest(1, CAST(floor(max(n) / greatest(1, min(n))) AS BIGINT)) AS positive_weight
FROM (SELECT count(*) AS n FROM {LD} GROUP BY quality)""")
def q_positive_class_weight(spark, sf):
    cc = H.class_counts_frame(labels_documents(spark, sf), "quality")
    return cc.agg(
        F.greatest(F.lit(1), F.floor(F.max("count") / F.greatest(F.lit(1), F.min("count")))).cast("long").alias("positive_weight")
    )


def sampling_targets_frame(df, target, ratio):
    """H8 preset targets as expressions over the class-count table."""
    cc = H.class_counts_frame(df, target)
    maj = F.max("count").over(W.partitionBy())
    t = F.greatest(F.col("count"), F.floor(maj * F.lit(ratio)).cast("long"))
    return cc.withColumn("target", t).where(F.col("target") > F.col("count"))


@register("sampling_targets", f"""
WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS count FROM {LD} GROUP BY 1),
t AS (SELECT class, count, greatest(count, CAST(floor(max(count) OVER () * 0.5) AS BIGINT)) AS target FROM c)
SELECT * FROM t WHERE target > count""")
def q_sampling_targets(spark, sf):
    return sampling_targets_frame(labels_documents(spark, sf), "toxic", H.SMOTE_PRESETS["moderate"])


@register("undersample", f"""
WITH c AS (SELECT CAST(toxic AS VARCHAR) AS g, count(*) AS n FROM {LD} GROUP BY 1),
m AS (SELECT min(n) AS t FROM c),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY CAST(toxic AS VARCHAR) ORDER BY {md5_sql(42, 'doc_id')}, doc_id) AS rn FROM {LD})
SELECT doc_id, toxic FROM r, m WHERE rn <= m.t""")
def q_undersample(spark, sf):
    df = labels_documents(spark, sf).select("doc_id", "toxic")
    counts = H.class_counts(df, "toxic")
    targets = H.sampling_targets(counts, "random_undersample")
    return H.undersample(df, "doc_id", "toxic", targets, 42)


_U = "(('0x' || substr(md5('42|' || d.g || '|' || CAST(d.j AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0)"


@register("oversample", f"""
WITH c AS (SELECT CAST(quality AS VARCHAR) AS g, count(*) AS n FROM {LD} GROUP BY 1),
t AS (SELECT g, n, max(n) OVER () - n AS need FROM c),
d AS (SELECT t.g, t.n, j FROM t, range(1, t.need + 1) AS r(j) WHERE t.need > 0),
d2 AS (SELECT d.g, d.j, CAST(floor({_U} * d.n) AS BIGINT) + 1 AS idx FROM d),
r AS (SELECT doc_id, quality, CAST(quality AS VARCHAR) AS g,
             row_number() OVER (PARTITION BY CAST(quality AS VARCHAR) ORDER BY {md5_sql(42, 'doc_id')}, doc_id) AS rk FROM {LD})
SELECT doc_id, quality, CAST(0 AS BIGINT) AS copy FROM {LD}
UNION ALL
SELECT r.doc_id, r.quality, d2.j AS copy FROM d2 JOIN r ON r.g = d2.g AND r.rk = d2.idx""")
def q_oversample(spark, sf):
    df = labels_documents(spark, sf).select("doc_id", "quality")
    counts = H.class_counts(df, "quality")
    targets = H.sampling_targets(counts, "random_oversample")
    return H.oversample(df, "doc_id", "quality", targets, 42)


# ---------------------------------------------------------------- I: preprocessing


@register("impute_median", f"""
WITH d AS {DIRTY_EVENTS_SQL},
m AS (SELECT median(CASE WHEN isnan(value) THEN NULL ELSE value END) AS med FROM d)
SELECT event_id, round(coalesce(CASE WHEN isnan(value) THEN NULL ELSE value END, m.med), 6) AS value FROM d, m""")
def q_impute_median(spark, sf):
    df = dirty_events(spark, sf).select("event_id", "value")
    p = P.fit(df, ["value"], strategy="median")
    out = P.transform(df, p, keep=["event_id"], with_label=False)
    return out.select("event_id", F.round("value", 6).alias("value"))


@register("impute_mean", f"""
WITH d AS {DIRTY_EVENTS_SQL},
m AS (SELECT avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS mu FROM d)
SELECT event_id, round(coalesce(CASE WHEN isnan(value) THEN NULL ELSE value END, m.mu), 6) AS value FROM d, m""")
def q_impute_mean(spark, sf):
    df = dirty_events(spark, sf).select("event_id", "value")
    p = P.fit(df, ["value"], strategy="mean")
    out = P.transform(df, p, keep=["event_id"], with_label=False)
    return out.select("event_id", F.round("value", 6).alias("value"))


@register("standard_scale", f"""
WITH s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(c_acctbal) AS m2, stddev_pop(c_acctbal) AS s2 FROM {OC})
SELECT o_orderkey,
       round((o_totalprice - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS o_totalprice,
       round((c_acctbal - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS c_acctbal
FROM {OC}, s""")
def q_standard_scale(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_totalprice", "c_acctbal")
    p = P.fit(df, ["o_totalprice", "c_acctbal"], scale=True)
    out = P.transform(df, p, keep=["o_orderkey"], with_label=False)
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), F.round("c_acctbal", 6).alias("c_acctbal"))


def _hot_long(out, p, key):
    """(key, feature, feature_index) for every hot one-hot cell."""
    names = p.output_names
    hot = [n for n in names if n not in p.numeric]
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(names.index(n)).alias("feature_index"), F.col(f"`{n}`").alias("v"))
                      for n in hot])
    return out.select(key, F.explode(items).alias("x")).where("x.v = 1.0").select(key, "x.feature", "x.feature_index")


def _hot_sql(src, key, numeric_count, cats):
    parts, offset = [], f"{numeric_count}"
    for c in cats:
        lv = f"(SELECT coalesce(CAST({c} AS VARCHAR), 'Unknown') AS v, dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'Unknown')) - 1 AS i FROM (SELECT DISTINCT {c} FROM {src}))"
        parts.append(f"""SELECT s.{key}, '{c}_' || l.v AS feature, CAST({offset} + l.i AS INTEGER) AS feature_index
FROM {src} s JOIN (SELECT DISTINCT * FROM {lv}) l ON coalesce(CAST(s.{c} AS VARCHAR), 'Unknown') = l.v""")
        offset += f" + (SELECT count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'Unknown')) FROM {src})"
    return "\nUNION ALL ".join(parts)


@register("one_hot", _hot_sql(OC, "o_orderkey", 1, ["o_orderpriority", "c_mktsegment"]))
def q_one_hot(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority", "c_mktsegment")
    p = P.fit(df, ["o_totalprice", "o_orderpriority", "c_mktsegment"])
    return _hot_long(P.transform(df, p, keep=["o_orderkey"], with_label=False), p, "o_orderkey")


@register("target_encode", """
SELECT class_label, CAST(dense_rank() OVER (ORDER BY class_label) - 1 AS INTEGER) AS class_id
FROM (SELECT DISTINCT coalesce(CAST(o_orderpriority AS VARCHAR), 'null') AS class_label FROM orders)""")
def q_target_encode(spark, sf):
    df = table(spark, sf, "orders")
    classes = P.target_classes(df, "o_orderpriority")
    return P.class_mapping(spark, classes)


@register("target_encode_rows", """
WITH m AS (SELECT class_label, dense_rank() OVER (ORDER BY class_label) - 1 AS class_id
           FROM (SELECT DISTINCT coalesce(CAST(event_type AS VARCHAR), 'null') AS class_label FROM events))
SELECT e.event_id, CAST(m.class_id AS DOUBLE) AS label FROM events e JOIN m ON coalesce(CAST(e.event_type AS VARCHAR), 'null') = m.class_label""")
def q_target_encode_rows(spark, sf):
    df = table(spark, sf, "events")
    classes = P.target_classes(df, "event_type")
    return df.select("event_id", P.encode_target_expr("event_type", classes).alias("label"))


TRAIN_CUT = "1999-01-01"


@register("transform_new", f"""
WITH tr AS (SELECT * FROM {OC} WHERE o_orderdate < TIMESTAMP '{TRAIN_CUT}'),
te AS (SELECT * FROM {OC} WHERE o_orderdate >= TIMESTAMP '{TRAIN_CUT}'),
s AS (SELECT median(c_acctbal) AS med FROM tr),
s2 AS (SELECT avg(coalesce(c_acctbal, med)) AS mu, stddev_pop(coalesce(c_acctbal, med)) AS sd FROM tr, s),
lv AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) AS INTEGER) AS i
       FROM (SELECT DISTINCT coalesce(CAST(c_nationkey AS VARCHAR), 'Unknown') AS v FROM tr))
SELECT te.o_orderkey, round((coalesce(te.c_acctbal, s.med) - s2.mu) / CASE WHEN s2.sd = 0 THEN 1 ELSE s2.sd END, 6) AS c_acctbal,
       coalesce(lv.i, 0) AS hot_index
FROM te CROSS JOIN s CROSS JOIN s2 LEFT JOIN lv ON coalesce(CAST(te.c_nationkey AS VARCHAR), 'Unknown') = lv.v""")
def q_transform_new(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderdate", "c_acctbal",
                                           F.col("c_nationkey").cast("string").alias("c_nationkey"))
    train = df.where(F.col("o_orderdate") < F.lit(TRAIN_CUT).cast("timestamp_ntz"))
    new = df.where(F.col("o_orderdate") >= F.lit(TRAIN_CUT).cast("timestamp_ntz"))
    p = P.fit(train, ["c_acctbal", "c_nationkey"], scale=True)
    out = P.transform(new, p, keep=["o_orderkey"], with_label=False)
    hot_cols = [n for n in p.output_names if n not in p.numeric]
    # 1-based position of the hot level (0 = unseen level, all zeros)
    pos = sum((F.col(f"`{n}`") * F.lit(i + 1)) for i, n in enumerate(hot_cols))
    return out.select("o_orderkey", F.round("c_acctbal", 6).alias("c_acctbal"), pos.cast("int").alias("hot_index"))


def _task_sql(src, col, kind):
    if kind == "string":
        return f"SELECT '{col}' AS target, CASE WHEN count({col}) > 0 THEN 'classification' ELSE 'unknown' END AS task_type FROM {src}"
    x = f"CAST({col} AS DOUBLE)"
    return f"""SELECT '{col}' AS target, CASE
  WHEN count({col}) = 0 THEN 'unknown'
  WHEN count(*) FILTER (WHERE {col} IS NOT NULL AND (isnan({x}) OR isinf({x}))) > 0 THEN 'classification'
  WHEN bool_and(abs({x} - round_even({x}, 0)) <= 1e-8 + 1e-5 * abs(round_even({x}, 0))) FILTER (WHERE {col} IS NOT NULL)
       AND (count(DISTINCT {col}) <= least(100, greatest(20, CAST(floor(sqrt(count({col}))) AS BIGINT)))
            OR count(DISTINCT {col}) / count({col}) <= 0.2) THEN 'classification'
  ELSE 'regression' END AS task_type FROM {src}"""


TASK_TARGETS = [("orders", "o_orderstatus", "string"), ("orders", "o_totalprice", "float"),
                ("lineitem", "l_quantity", "float"), ("customer", "c_nationkey", "int"), ("events", "value", "float")]


@register("task_type", "\nUNION ALL ".join(_task_sql(t, c, k) for t, c, k in TASK_TARGETS))
def q_task_type(spark, sf):
    rows = [(c, P.detect_task_type(table(spark, sf, t), c)) for t, c, _ in TASK_TARGETS]
    # the driver-side decision is tiny; it is attached to a frame derived from the data
    return spark.createDataFrame(rows, "target string, task_type string")
