"""Evaluation queries (L1-L12, C6, K11, K13) on a closed-form model's scores.

Model: Gaussian naive Bayes of ``o_orderstatus`` from (o_totalprice,
c_acctbal), trained on orders before 1999 and scored on later orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import models as M
from ..sources.tables import ORDERS_CUSTOMER_SQL, orders_customer, table
from .registry import register

OC = ORDERS_CUSTOMER_SQL
CUT = "1999-01-01"
FEATS = ["o_totalprice", "c_acctbal"]
CLASSES = ["F", "O", "P"]  # o_orderstatus levels of the shared orders table
PCOLS = [f"p_{c}" for c in CLASSES]


def nb_scored(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderdate", *FEATS)
    cut = F.lit(CUT).cast("timestamp_ntz")
    train = df.where(F.col("o_orderdate") < cut)
    test = df.where(F.col("o_orderdate") >= cut)
    model = M.fit_gaussian_nb(train, FEATS, "o_orderstatus")
    scored = M.predict_gaussian_nb(test.withColumnRenamed("o_orderstatus", "actual"), model)
    return scored.select("o_orderkey", "actual", "predicted", *[f"p_{c}" for c in model.classes])


_PIVOT = ",\n  ".join(f"max(CASE WHEN c = '{c}' THEN round(p, 9) END) AS p_{c}" for c in CLASSES)
NB_SQL = f"""
tr AS (SELECT * FROM {OC} WHERE o_orderdate < TIMESTAMP '{CUT}'),
te AS (SELECT * FROM {OC} WHERE o_orderdate >= TIMESTAMP '{CUT}'),
eps AS (SELECT 1e-9 * greatest(var_pop(o_totalprice), var_pop(c_acctbal)) AS e, count(*) AS n FROM tr),
st AS (SELECT CAST(o_orderstatus AS VARCHAR) AS c, count(*) / any_value(eps.n) AS prior,
              avg(o_totalprice) AS m1, var_pop(o_totalprice) + any_value(eps.e) AS v1,
              avg(c_acctbal) AS m2, var_pop(c_acctbal) + any_value(eps.e) AS v2
       FROM tr, eps GROUP BY 1),
j AS (SELECT te.o_orderkey, CAST(te.o_orderstatus AS VARCHAR) AS actual, st.c,
             ln(st.prior) - 0.5 * (ln(2 * pi() * st.v1) + ln(2 * pi() * st.v2))
             - 0.5 * ((te.o_totalprice - st.m1) ^ 2 / st.v1 + (te.c_acctbal - st.m2) ^ 2 / st.v2) AS jll
      FROM te, st),
jm AS (SELECT *, max(jll) OVER (PARTITION BY o_orderkey) AS mx FROM j),
jp AS (SELECT *, exp(jll - mx) / sum(exp(jll - mx)) OVER (PARTITION BY o_orderkey) AS p FROM jm),
sc AS (SELECT o_orderkey, any_value(actual) AS actual, arg_max(c, jll) AS predicted,
  {_PIVOT}
FROM jp GROUP BY o_orderkey)"""

LONG_SQL = " UNION ALL ".join(f"SELECT o_orderkey, actual, '{c}' AS class, p_{c} AS score FROM sc" for c in CLASSES)
COUNTS_SQL = f"""
sl AS ({LONG_SQL}),
cnt AS (SELECT class, score, count(*) FILTER (WHERE actual = class) AS pos, count(*) FILTER (WHERE actual <> class) AS neg
        FROM sl GROUP BY 1, 2),
ct AS (SELECT class, score, pos, neg,
         sum(pos) OVER (PARTITION BY class) AS "P", sum(neg) OVER (PARTITION BY class) AS "N",
         count(*) OVER (PARTITION BY class) AS m,
         row_number() OVER (PARTITION BY class ORDER BY score) AS rank,
         coalesce(sum(pos) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
         coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
       FROM cnt),
ct2 AS (SELECT *, "P" - pos_below AS tps, "N" - neg_below AS fps FROM ct),
auc AS (SELECT class, sum(pos * (neg_below + 0.5 * neg)) / (any_value("P") * any_value("N")) AS auc,
               any_value("P") AS "P", any_value("N") AS "N" FROM ct2 GROUP BY class)"""

CELLS_SQL = """
labs AS (SELECT actual AS l FROM sc UNION SELECT predicted FROM sc),
cells0 AS (SELECT actual, predicted, count(*) AS n FROM sc GROUP BY 1, 2),
cells AS (SELECT a.l AS actual, p.l AS predicted, coalesce(c.n, 0) AS n
          FROM labs a CROSS JOIN labs p LEFT JOIN cells0 c ON c.actual = a.l AND c.predicted = p.l),
pc0 AS (SELECT l AS class,
          coalesce((SELECT sum(n) FROM cells WHERE actual = l AND predicted = l), 0) AS tp,
          coalesce((SELECT sum(n) FROM cells WHERE actual = l), 0) AS support,
          coalesce((SELECT sum(n) FROM cells WHERE predicted = l), 0) AS predicted_n FROM labs),
pc AS (SELECT class, tp, support, predicted_n,
          CASE WHEN predicted_n > 0 THEN tp / predicted_n ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pcf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
        FROM pc WHERE support > 0 OR predicted_n > 0)"""


def _r(c, d=9):
    return F.round(c, d)


@register("gaussian_nb", f"WITH {NB_SQL}\nSELECT * FROM sc")
def q_gaussian_nb(spark, sf):
    return nb_scored(spark, sf)


@register("confusion", f"WITH {NB_SQL}, {CELLS_SQL}\nSELECT actual, predicted, n FROM cells")
def q_confusion(spark, sf):
    return E.confusion(nb_scored(spark, sf), "actual", "predicted")


@register("confusion_normalized", f"""WITH {NB_SQL}, {CELLS_SQL}
SELECT actual, predicted, n,
       round(CASE WHEN sum(n) OVER (PARTITION BY actual) > 0 THEN n * 100.0 / sum(n) OVER (PARTITION BY actual) ELSE 0.0 END, 9) AS percent
FROM cells""")
def q_confusion_normalized(spark, sf):
    t = E.normalized_confusion(E.confusion(nb_scored(spark, sf), "actual", "predicted"))
    return t.withColumn("percent", _r(F.col("percent")))


@register("metrics_classification", f"""WITH {NB_SQL}, {CELLS_SQL}
SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision,
       round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
       round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
       round(avg(recall) FILTER (WHERE support > 0), 9) AS balanced_accuracy
FROM pcf""")
def q_metrics_classification(spark, sf):
    m = E.classification_metrics(E.confusion(nb_scored(spark, sf), "actual", "predicted"))
    return m.select(*[_r(F.col(c)).alias(c) for c in m.columns])


@register("classification_report", f"""WITH {NB_SQL}, {CELLS_SQL}
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM pcf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), sum(support) FROM pcf
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support) FROM pcf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
                 round(sum(f1 * support) / sum(support), 9), sum(support) FROM pcf""")
def q_classification_report(spark, sf):
    r = E.classification_report(E.confusion(nb_scored(spark, sf), "actual", "predicted"))
    return r.select("class", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def _counts(spark, sf):
    s = nb_scored(spark, sf)
    return E.score_counts(s, "actual", CLASSES, PCOLS)


@register("roc_auc", f"""WITH {NB_SQL}, {COUNTS_SQL}
SELECT CASE WHEN count(*) FILTER (WHERE "P" = 0 OR "N" = 0) > 0 THEN NULL ELSE round(avg(auc), 9) END AS roc_auc FROM auc""")
def q_roc_auc(spark, sf):
    return E.roc_auc(_counts(spark, sf)).select(_r(F.col("roc_auc")).alias("roc_auc"))


@register("roc_curve", f"""WITH {NB_SQL}, {COUNTS_SQL},
r AS (SELECT *, m - rank AS i FROM ct2),
nb AS (SELECT r.*, p.tps AS tp_prev, p.fps AS fp_prev, n.tps AS tp_next, n.fps AS fp_next
      FROM r LEFT JOIN r p ON p.class = r.class AND p.i + 1 = r.i LEFT JOIN r n ON n.class = r.class AND n.i - 1 = r.i),
k AS (SELECT class, fps / "N" AS fpr, tps / "P" AS tpr, score AS threshold FROM nb
      WHERE i = 0 OR i = m - 1 OR m <= 2 OR (fp_next - 2 * fps + fp_prev) <> 0 OR (tp_next - 2 * tps + tp_prev) <> 0
      UNION ALL SELECT DISTINCT class, 0.0, 0.0, 'Infinity'::DOUBLE FROM cnt)
SELECT k.class, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, threshold, round(auc.auc, 9) AS auc FROM k JOIN auc ON k.class = auc.class""")
def q_roc_curve(spark, sf):
    c = E.roc_curve(_counts(spark, sf))
    return c.select("class", _r(F.col("fpr")).alias("fpr"), _r(F.col("tpr")).alias("tpr"), "threshold", _r(F.col("auc")).alias("auc"))


@register("pr_curve", f"""WITH {NB_SQL}, {COUNTS_SQL},
pts AS (SELECT class, score, pos, "P",
          CASE WHEN "P" > 0 THEN tps / "P" ELSE 1.0 END AS recall,
          CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END AS precision FROM ct2),
ap AS (SELECT class, sum(CASE WHEN "P" > 0 THEN pos / "P" ELSE 0.0 END * precision) AS average_precision FROM pts GROUP BY class),
allp AS (SELECT class, recall, precision, score AS threshold FROM pts
         UNION ALL SELECT class, 0.0, 1.0, max(score) FROM ct2 GROUP BY class)
SELECT allp.class, round(recall, 9) AS recall, round(precision, 9) AS precision, threshold,
       round(average_precision, 9) AS average_precision FROM allp JOIN ap ON allp.class = ap.class""")
def q_pr_curve(spark, sf):
    c = E.pr_curve(_counts(spark, sf))
    return c.select("class", _r(F.col("recall")).alias("recall"), _r(F.col("precision")).alias("precision"),
                    "threshold", _r(F.col("average_precision")).alias("average_precision"))


@register("macro_curve", f"""WITH {NB_SQL}, {COUNTS_SQL},
r AS (SELECT *, m - rank AS i FROM ct2),
nb AS (SELECT r.*, p.tps AS tp_prev, p.fps AS fp_prev, n.tps AS tp_next, n.fps AS fp_next
      FROM r LEFT JOIN r p ON p.class = r.class AND p.i + 1 = r.i LEFT JOIN r n ON n.class = r.class AND n.i - 1 = r.i),
k AS (SELECT class, fps / "N" AS x, tps / "P" AS y FROM nb
      WHERE i = 0 OR i = m - 1 OR m <= 2 OR (fp_next - 2 * fps + fp_prev) <> 0 OR (tp_next - 2 * tps + tp_prev) <> 0
      UNION ALL SELECT DISTINCT class, 0.0, 0.0 FROM cnt),
o AS (SELECT class, x, y, lead(x) OVER (PARTITION BY class ORDER BY x, y) AS nx, lead(y) OVER (PARTITION BY class ORDER BY x, y) AS ny,
             row_number() OVER (PARTITION BY class ORDER BY x, y) = 1 AS first FROM k),
g AS (SELECT range AS gi, range / 200.0 AS grid FROM range(0, 201)),
v AS (SELECT o.class, g.gi, g.grid,
        CASE WHEN g.grid < o.x THEN o.y WHEN o.nx IS NULL THEN o.y ELSE o.y + (o.ny - o.y) * (g.grid - o.x) / (o.nx - o.x) END AS val
      FROM o JOIN g ON (o.first AND g.grid < o.x) OR (g.grid >= o.x AND (o.nx IS NULL OR g.grid < o.nx)))
SELECT gi AS grid_index, grid, round(avg(val), 9) AS tpr FROM v GROUP BY gi, grid""")
def q_macro_curve(spark, sf):
    c = E.roc_curve(_counts(spark, sf))
    m = E.macro_curve(c, "fpr", "tpr")
    return m.select(F.col("grid_index").cast("long").alias("grid_index"), "grid", _r(F.col("tpr")).alias("tpr"))


@register("misclassified", f"""WITH {NB_SQL}
SELECT o_orderkey, actual, predicted, greatest({', '.join(PCOLS)}) AS confidence FROM sc WHERE actual <> predicted""")
def q_misclassified(spark, sf):
    s = nb_scored(spark, sf)
    return E.misclassified(s, "actual", "predicted", PCOLS).select("o_orderkey", "actual", "predicted", "confidence")


@register("linear_regression", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT round(b, 6) AS slope, round(a, 6) AS intercept FROM f""")
def q_linear_regression(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"),
                  F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 6).alias("intercept"))


@register("metrics_regression", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, f),
mu AS (SELECT avg(y) AS m FROM p)
SELECT round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) ^ 2)), 6) AS rmse,
       round(1 - sum((yhat - y) ^ 2) / sum((y - m) ^ 2), 9) AS r2,
       round(avg(abs(yhat - y) / greatest(abs(y), 2.220446049250313e-16)), 9) AS mape FROM p, mu""")
def q_metrics_regression(spark, sf):
    li = table(spark, sf, "lineitem")
    fit = M.fit_simple_linear(li, "l_quantity", "l_extendedprice")
    pred = li.select(F.col("l_extendedprice").alias("y"),
                     (F.lit(fit.intercept) + F.lit(fit.slope) * F.col("l_quantity")).alias("yhat"))
    m = E.regression_metrics(pred, "y", "yhat")
    return m.select(_r(F.col("mae"), 6).alias("mae"), _r(F.col("rmse"), 6).alias("rmse"),
                    _r(F.col("r2")).alias("r2"), _r(F.col("mape")).alias("mape"))
