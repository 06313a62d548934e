"""Neighbour-based operators: SMOTE, SMOTE-NC (H5-H7, H11) and the k-NN classifier.

Oracles are brute force over all same-class pairs in SQL; the Spark side
never forms all pairs (pivot cells + bound, see ``operators.knn``).
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import imbalance as H
from ..operators import split as S
from ..operators.knn import knn_within_groups
from ..operators.smote import synthetic_samples
from ..sources.tables import LABELS_DOCUMENTS_SQL, labels_documents, table
from .registry import register
from .sqlgen import stratified_holdout_ctes


def _u(role: str) -> str:
    return f"(('0x' || substr(md5('42|' || d.g || '|' || CAST(d.j AS VARCHAR) || '|{role}'), 1, 8))::UBIGINT / 4294967296.0)"


def _smote_sql(src: str, key: str, target: str, vec_sql: str, dist_sql: str, k: int) -> str:
    """Brute-force SMOTE oracle over ``src`` with vector expression ``vec_sql``."""
    return f"""
e AS (SELECT {key} AS key, CAST({target} AS VARCHAR) AS g, {vec_sql} AS v, * FROM {src}),
c AS (SELECT g, count(*) AS n FROM e GROUP BY g),
t AS (SELECT g, n, max(n) OVER () - n AS need, least({k}, n - 1) AS kk FROM c),
kg AS (SELECT greatest(1, least({k}, min(n) - 1)) AS k FROM c),
pairs AS (SELECT a.g, a.key AS q, b.key AS nk, {dist_sql} AS dist
          FROM e a JOIN e b ON a.g = b.g AND a.key <> b.key JOIN t ON t.g = a.g WHERE t.need > 0),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY dist, CAST(nk AS VARCHAR)) AS rk FROM pairs), kg
       WHERE rk <= kg.k),
ranked AS (SELECT key, g, v, row_number() OVER (PARTITION BY g ORDER BY md5('42|' || CAST(key AS VARCHAR)), key) AS rk FROM e),
dr AS (SELECT t.g, t.n, j FROM t, range(1, t.need + 1) AS r(j) WHERE t.need > 0),
d AS (SELECT dr.g, dr.j, dr.n FROM dr),
d2 AS (SELECT d.g, d.j, CAST(floor({_u('base')} * d.n) AS BIGINT) + 1 AS idx,
              CAST(floor({_u('nn')} * least(kg.k, d.n - 1)) AS BIGINT) + 1 AS pick, {_u('step')} AS step FROM d, kg),
syn AS (SELECT d2.g, d2.j, d2.step, b.key AS base_key, nn.nk AS nn_key, b.v AS bv, m.v AS nv
        FROM d2 JOIN ranked b ON b.g = d2.g AND b.rk = d2.idx
        JOIN nn ON nn.g = d2.g AND nn.q = b.key AND nn.rk = d2.pick
        JOIN e m ON m.key = nn.nk AND m.g = d2.g)"""


EMB_SQL = _smote_sql("embeddings", "vec_id", "label", "CAST(embedding AS DOUBLE[])", "list_distance(a.v, b.v)", 5)


@register("smote", f"""WITH {EMB_SQL}
SELECT CAST(g AS INTEGER) AS label, j AS draw, base_key, CAST(nn_key AS BIGINT) AS nn_key, round(step, 9) AS step,
       round(bv[1] + step * (nv[1] - bv[1]), 6) AS s0, round(bv[64] + step * (nv[64] - bv[64]), 6) AS s63
FROM syn""")
def q_smote(spark, sf):
    df = table(spark, sf, "embeddings")
    counts = H.class_counts(df, "label")
    targets = H.sampling_targets(counts, "smote")
    k = H.validated_k(counts, targets, 5, auto=True)
    syn = synthetic_samples(df, "vec_id", "label", "embedding", targets, k, 42)
    return syn.select(
        F.col("_c").cast("int").alias("label"), F.col("_j").alias("draw"), F.col("base_key"),
        F.col("nn_key").cast("long").alias("nn_key"), F.round("_step", 9).alias("step"),
        F.round(F.element_at("_v", 1), 6).alias("s0"), F.round(F.element_at("_v", 64), 6).alias("s63"),
    )


# SMOTE-NC on labels x documents: numeric n_chars, nominal lang; penalty median(std)^2 / 2 (one numeric
# feature: the median std is that feature's population std within the class).
LD_NC_SQL = _smote_sql(
    f"(SELECT x.*, s.sd FROM {LABELS_DOCUMENTS_SQL} x JOIN (SELECT quality AS q2, stddev_pop(n_chars) AS sd FROM {LABELS_DOCUMENTS_SQL} GROUP BY 1) s ON x.quality = s.q2)",
    "doc_id", "quality", "[CAST(n_chars AS DOUBLE)]",
    "sqrt((a.n_chars - b.n_chars) ^ 2 + CASE WHEN a.lang <> b.lang THEN a.sd * a.sd / 2 ELSE 0 END)", 5)


@register("smote_nc", f"""WITH {LD_NC_SQL},
modes AS (SELECT nn.g, nn.q, m.lang, count(*) AS c FROM nn JOIN e m ON m.key = nn.nk AND m.g = nn.g GROUP BY 1, 2, 3),
mode AS (SELECT g, q, arg_min(lang, (-c, lang)) AS lang FROM modes GROUP BY 1, 2)
SELECT CAST(syn.g AS INTEGER) AS quality, j AS draw, base_key, CAST(nn_key AS BIGINT) AS nn_key, round(step, 9) AS step,
       round(bv[1] + step * (nv[1] - bv[1]), 6) AS n_chars, mode.lang
FROM syn JOIN mode ON mode.g = syn.g AND mode.q = syn.base_key""")
def q_smote_nc(spark, sf):
    df = labels_documents(spark, sf).select("doc_id", "quality", "n_chars", "lang")
    counts = H.class_counts(df, "quality")
    targets = H.sampling_targets(counts, "smote_nc")
    k = H.validated_k(counts, targets, 5, auto=True)
    syn = synthetic_samples(df, "doc_id", "quality", ["n_chars"], targets, k, 42, categorical=["lang"])
    return syn.select(
        F.col("_c").cast("int").alias("quality"), F.col("_j").alias("draw"), F.col("base_key"),
        F.col("nn_key").cast("long").alias("nn_key"), F.round("_step", 9).alias("step"),
        F.round(F.element_at("_v", 1), 6).alias("n_chars"), "lang",
    )


KNN_SQL = f"""WITH {stratified_holdout_ctes('h', 'embeddings', 'vec_id', 'label', 0.2, 42)},
e AS (SELECT x.vec_id, x.label, CAST(x.embedding AS DOUBLE[]) AS v, h.is_test FROM embeddings x JOIN h ON x.vec_id = h.vec_id),
pairs AS (SELECT a.vec_id AS q, a.label AS actual, b.vec_id AS nk, b.label AS nl, list_distance(a.v, b.v) AS dist
          FROM e a JOIN e b ON a.is_test = 1 AND b.is_test = 0),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, CAST(nk AS VARCHAR)) AS rk FROM pairs) WHERE rk <= 5),
votes AS (SELECT q, any_value(actual) AS actual, nl, count(*) AS c FROM nn GROUP BY q, nl)
SELECT q AS vec_id, any_value(actual) AS actual, arg_min(nl, (-c, nl)) AS predicted FROM votes GROUP BY q"""


@register("knn", KNN_SQL)
def q_knn(spark, sf):
    df = table(spark, sf, "embeddings")
    marked = S.mark_train(df, "vec_id", "stratified", 0.2, 42, target="label").withColumn("_test", ~F.col("_train")).drop("_train")
    nn = knn_within_groups(marked, "vec_id", None, "embedding", 5, 42,
                           query=F.col("_test"), member=~F.col("_test"))
    lab = df.select(F.col("vec_id").cast("string").alias("nn_key"), F.col("label").alias("nl"))
    votes = nn.join(lab, "nn_key").groupBy("key", "nl").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("key").orderBy(F.desc("c"), F.asc("nl"))
    pred = votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("key").cast("long").alias("vec_id"), F.col("nl").alias("predicted"))
    return pred.join(df.select("vec_id", F.col("label").alias("actual")), "vec_id")
