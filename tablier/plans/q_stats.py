"""Statistics queries (M4, M5, M7, M10-M16) on closed-form model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import models as M
from ..operators import split as S
from ..operators import stats as T
from ..sources.tables import ORDERS_CUSTOMER_SQL, orders_customer, table
from .q_eval import CLASSES, CUT, FEATS, NB_SQL, PCOLS, nb_scored
from .registry import register
from .sqlgen import random_holdout_ctes

OC = ORDERS_CUSTOMER_SQL


def nb_ctes(sfx: str, tr: str, te: str, feats: list[str]) -> str:
    """Gaussian NB oracle CTEs ending in sc{sfx}(o_orderkey, actual, predicted, p_*)."""
    eps = " , ".join(f"var_pop({f})" for f in feats)
    eps_expr = f"greatest({eps})" if len(feats) > 1 else eps
    mv = ",\n  ".join(f"avg({f}) AS m{i}, var_pop({f}) + any_value(e{sfx}.e) AS v{i}" for i, f in enumerate(feats))
    lv = " + ".join(f"ln(2 * pi() * st{sfx}.v{i})" for i in range(len(feats)))
    qv = " + ".join(f"(te{sfx}.{f} - st{sfx}.m{i}) ^ 2 / st{sfx}.v{i}" for i, f in enumerate(feats))
    piv = ",\n  ".join(f"max(CASE WHEN c = '{c}' THEN round(p, 9) END) AS p_{c}" for c in CLASSES)
    return f"""
tr{sfx} AS ({tr}),
te{sfx} AS ({te}),
e{sfx} AS (SELECT 1e-9 * {eps_expr} AS e, count(*) AS n FROM tr{sfx}),
st{sfx} AS (SELECT CAST(o_orderstatus AS VARCHAR) AS c, count(*) / any_value(e{sfx}.n) AS prior,
  {mv}
  FROM tr{sfx}, e{sfx} GROUP BY 1),
j{sfx} AS (SELECT te{sfx}.o_orderkey, CAST(te{sfx}.o_orderstatus AS VARCHAR) AS actual, st{sfx}.c,
  ln(st{sfx}.prior) - 0.5 * ({lv}) - 0.5 * ({qv}) AS jll FROM te{sfx}, st{sfx}),
jm{sfx} AS (SELECT *, max(jll) OVER (PARTITION BY o_orderkey) AS mx FROM j{sfx}),
jp{sfx} AS (SELECT *, exp(jll - mx) / sum(exp(jll - mx)) OVER (PARTITION BY o_orderkey) AS p FROM jm{sfx}),
sc{sfx} AS (SELECT o_orderkey, any_value(actual) AS actual, arg_max(c, jll) AS predicted,
  {piv}
  FROM jp{sfx} GROUP BY o_orderkey)"""


TR = f"SELECT * FROM {OC} WHERE o_orderdate < TIMESTAMP '{CUT}'"
TE = f"SELECT * FROM {OC} WHERE o_orderdate >= TIMESTAMP '{CUT}'"


def _nb_model(spark, sf, feats, train_where, test_where, renamed=True):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderdate", *FEATS)
    model = M.fit_gaussian_nb(df.where(train_where), feats, "o_orderstatus")
    test = df.where(test_where).withColumnRenamed("o_orderstatus", "actual")
    return M.predict_gaussian_nb(test, model)


def _cut():
    return F.lit(CUT).cast("timestamp_ntz")


# ------------------------------------------------------------------ Cramér's V / VIF


def _cv_sql():
    feats_num = ["o_totalprice", "c_acctbal"]
    feats_cat = ["o_orderpriority", "c_mktsegment"]
    rng = ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in feats_num)
    parts = []
    for f in feats_num:
        edges = " + ".join(
            f"CASE WHEN {f} > (r.lo_{f} + {i} * ((r.hi_{f} - r.lo_{f}) / 10.0)) THEN 1 ELSE 0 END" for i in range(1, 10)
        )
        parts.append(f"SELECT '{f}' AS feature, CASE WHEN {f} IS NULL OR isnan({f}) THEN 'nan' "
                     f"WHEN r.hi_{f} = r.lo_{f} THEN '0' ELSE CAST({edges} AS VARCHAR) END AS value, "
                     f"CAST(o_orderstatus AS VARCHAR) AS y FROM {OC}, r")
    for f in feats_cat:
        parts.append(f"SELECT '{f}', coalesce(CAST({f} AS VARCHAR), 'nan'), CAST(o_orderstatus AS VARCHAR) FROM {OC}")
    body = "\nUNION ALL ".join(parts)
    return f"""WITH r AS (SELECT {rng} FROM {OC}),
l AS ({body}),
ct AS (SELECT feature, value, y, count(*) AS o FROM l WHERE y IS NOT NULL GROUP BY 1, 2, 3),
ct2 AS (SELECT *, sum(o) OVER (PARTITION BY feature, value) AS "R", sum(o) OVER (PARTITION BY feature, y) AS "C",
               sum(o) OVER (PARTITION BY feature) AS n FROM ct),
per AS (SELECT feature, any_value(n) * (sum(o * o / ("R" * "C")) - 1) AS chi2, any_value(n) AS n,
               count(DISTINCT value) AS r, count(DISTINCT y) AS c FROM ct2 GROUP BY feature),
v AS (SELECT feature, greatest(0.0, chi2 / n - (r - 1) * (c - 1) / (n - 1)) AS phi2,
             least(r - (r - 1) * (r - 1) / (n - 1) - 1, c - (c - 1) * (c - 1) / (n - 1) - 1) AS denom FROM per)
SELECT feature, round(CASE WHEN denom > 0 THEN sqrt(phi2 / denom) ELSE 0.0 END, 4) AS cramers_v FROM v"""


@register("cramers_v", _cv_sql())
def q_cramers_v(spark, sf):
    df = orders_customer(spark, sf)
    return T.cramers_v(df, ["o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"], "o_orderstatus")


VIF_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _vif_sql():
    x = VIF_COLS
    g = {}
    for i in range(3):
        for j in range(3):
            a, b = sorted((i, j))
            g[(i, j)] = f"g{a}{b}"
    sums = ", ".join(f"sum({x[i]} * {x[j]}) AS g{i}{j}" for i in range(3) for j in range(i, 3))

    def cof(i):
        r = [k for k in range(3) if k != i]
        return f"({g[(r[0], r[0])]} * {g[(r[1], r[1])]} - {g[(r[0], r[1])]} * {g[(r[1], r[0])]})"

    det = (f"(g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02))")
    rows = "\nUNION ALL ".join(
        f"SELECT '{x[i]}' AS feature, round({g[(i, i)]} * {cof(i)} / {det}, 2) AS vif FROM s" for i in range(3)
    )
    return f"WITH s AS (SELECT {sums} FROM lineitem)\n{rows}"


@register("vif", _vif_sql())
def q_vif(spark, sf):
    rows = T.vif(table(spark, sf, "lineitem"), VIF_COLS)
    # the p x p result is tiny; it is returned through a frame built from the aggregate
    return spark.createDataFrame([(c, round(v, 2)) for c, v in rows], "feature string, vif double")


# ------------------------------------------------------------------ subgroups, McNemar


@register("subgroup_metrics", f"""WITH {NB_SQL},
x AS (SELECT sc.*, o.c_mktsegment AS subgroup FROM sc JOIN {OC} o ON sc.o_orderkey = o.o_orderkey),
cells AS (SELECT subgroup, actual AS a, predicted AS p, count(*) AS n FROM x GROUP BY 1, 2, 3),
cls AS (SELECT subgroup, a AS class FROM cells UNION SELECT subgroup, p FROM cells),
pc AS (SELECT cls.subgroup, cls.class,
          coalesce((SELECT sum(n) FROM cells c WHERE c.subgroup = cls.subgroup AND c.a = cls.class AND c.p = cls.class), 0) AS tp,
          coalesce((SELECT sum(n) FROM cells c WHERE c.subgroup = cls.subgroup AND c.a = cls.class), 0) AS support,
          coalesce((SELECT sum(n) FROM cells c WHERE c.subgroup = cls.subgroup AND c.p = cls.class), 0) AS pred_n FROM cls),
pm AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM pc)
SELECT subgroup, round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END), 9) AS macro_f1,
       round(avg(rc) FILTER (WHERE support > 0), 9) AS balanced_accuracy,
       round(max(rc) FILTER (WHERE class = 'F'), 9) AS class_recall, sum(support) AS support
FROM pm GROUP BY subgroup HAVING sum(support) >= 30""")
def q_subgroup_metrics(spark, sf):
    s = nb_scored(spark, sf)
    seg = orders_customer(spark, sf).select("o_orderkey", "c_mktsegment")
    x = s.join(seg, "o_orderkey")  # E5: attach predictions to the original rows
    m = T.subgroup_metrics(x, "c_mktsegment", "actual", "predicted", chosen_class="F", min_support=30)
    return m.select("subgroup", *[F.round(c, 9).alias(c) for c in ("macro_f1", "balanced_accuracy", "class_recall")], "support")


MC_MODELS = {"nb_both": FEATS, "nb_price": ["o_totalprice"], "nb_balance": ["c_acctbal"]}


def _mc_frame(spark, sf):
    frames = []
    for name, feats in MC_MODELS.items():
        s = _nb_model(spark, sf, feats, F.col("o_orderdate") < _cut(), F.col("o_orderdate") >= _cut())
        frames.append(s.select("o_orderkey", "actual", F.col("predicted").alias(name)))
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.drop("actual"), "o_orderkey")  # E6: align the models' predictions on the key
    return out


def _mc_sql():
    ctes = ",".join(nb_ctes(f"_{i}", TR, TE, feats) for i, feats in enumerate(MC_MODELS.values()))
    names = list(MC_MODELS)
    pairs = []
    for i in range(3):
        for j in range(i + 1, 3):
            pairs.append(f"""SELECT '{names[i]}' AS m1, '{names[j]}' AS m2,
  count(*) FILTER (WHERE a.predicted = a.actual AND b.predicted <> b.actual) AS b,
  count(*) FILTER (WHERE a.predicted <> a.actual AND b.predicted = b.actual) AS c
FROM sc_{i} a JOIN sc_{j} b ON a.o_orderkey = b.o_orderkey""")
    return f"""WITH {ctes},
pr AS ({' UNION ALL '.join(pairs)})
SELECT m1, m2, b, c, round(power(abs(b - c) - 1, 2) / (b + c), 9) AS chi2 FROM pr WHERE b + c > 0"""


@register("mcnemar", _mc_sql())
def q_mcnemar(spark, sf):
    t = T.mcnemar(_mc_frame(spark, sf), "o_orderkey", "actual", list(MC_MODELS))
    return t.withColumn("chi2", F.round("chi2", 9))


# The chi-square quantiles (one degree of freedom) at 0.95, 0.99 and 0.999.
_STARS = "CASE WHEN chi2 > 10.827566170662733 THEN '***' WHEN chi2 > 6.634896601021213 THEN '**' WHEN chi2 > 3.841458820694124 THEN '*' ELSE 'n.s.' END"


@register("mcnemar_marks", f"""SELECT m1, m2, CASE WHEN chi2 > 3.841458820694124 THEN 'sig' ELSE 'n.s.' END AS sig, {_STARS} AS stars FROM ({_mc_sql()})""")
def q_mcnemar_marks(spark, sf):
    """The marks of the pairs, from the p-values."""
    return q_mcnemar_significance(spark, sf).select("m1", "m2", "sig", "stars")


@register("mcnemar_significance")
def q_mcnemar_significance(spark, sf):
    t = T.mcnemar(_mc_frame(spark, sf), "o_orderkey", "actual", list(MC_MODELS))
    p = T.chi2_sf_1(F.col("chi2"))
    t = t.withColumn("p", p)
    return t.withColumn("sig", F.when(F.col("p") < 0.05, "sig").otherwise("n.s.")) \
            .withColumn("stars", T.significance(F.col("p"))).withColumn("neg_log10_p", T.neg_log10(F.col("p")))


# ------------------------------------------------------------------ thresholds


def _pr_points(spark, sf):
    counts = E.score_counts(nb_scored(spark, sf), "actual", CLASSES, PCOLS)
    t = E.curve_table(counts)
    prec = F.when(F.col("tps") + F.col("fps") > 0, F.col("tps") / (F.col("tps") + F.col("fps"))).otherwise(0.0)
    rec = F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(1.0)
    return t.select("class", F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"))


THRESH_SQL = """,
sl AS ({long}),
cnt AS (SELECT class, score, count(*) FILTER (WHERE actual = class) AS pos, count(*) FILTER (WHERE actual <> class) AS neg FROM sl GROUP BY 1, 2),
ct AS (SELECT class, score, sum(pos) OVER (PARTITION BY class) AS "P",
         coalesce(sum(pos) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
         coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
         sum(neg) OVER (PARTITION BY class) AS "N" FROM cnt),
pts AS (SELECT class, score AS threshold,
          CASE WHEN ("P" - pb) + ("N" - nb) > 0 THEN ("P" - pb) / (("P" - pb) + ("N" - nb)) ELSE 0.0 END AS precision,
          CASE WHEN "P" > 0 THEN ("P" - pb) / "P" ELSE 1.0 END AS recall FROM ct),
f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pts),
th AS (SELECT class, arg_min(threshold, (-f1, threshold)) AS threshold, max(f1) AS f1 FROM f GROUP BY class)"""


def _thresh_sql(long_from="sc"):
    long = " UNION ALL ".join(f"SELECT o_orderkey, actual, '{c}' AS class, p_{c} AS score FROM {long_from}" for c in CLASSES)
    return THRESH_SQL.format(long=long)


@register("threshold_calibration", f"WITH {NB_SQL}{_thresh_sql()}\nSELECT class, threshold, round(f1, 9) AS f1 FROM th")
def q_threshold_calibration(spark, sf):
    th = T.calibrate_thresholds(_pr_points(spark, sf))
    return th.select("class", "threshold", F.round("f1", 9).alias("f1"))


def _apply_sql():
    m = [f"(p_{c} - coalesce((SELECT threshold FROM th WHERE class = '{c}'), 0.5))" for c in CLASSES]
    margins = ", ".join(f"{e} AS m_{c}" for e, c in zip(m, CLASSES))

    def argmax(cols):
        # first index wins ties
        expr = f"'{CLASSES[-1]}'"
        for i in reversed(range(len(cols) - 1)):
            conds = []
            for j in range(len(cols)):
                if j != i:
                    conds.append(f"{cols[i]} {'>' if j < i else '>='} {cols[j]}")
            expr = f"CASE WHEN {' AND '.join(conds)} THEN '{CLASSES[i]}' ELSE {expr} END"
        return expr

    mc = [f"m_{c}" for c in CLASSES]
    return f"""WITH {NB_SQL}{_thresh_sql()},
mg AS (SELECT sc.*, {margins} FROM sc)
SELECT o_orderkey, CASE WHEN greatest({', '.join(mc)}) < 0 THEN {argmax(PCOLS)} ELSE {argmax(mc)} END AS predicted_calibrated FROM mg"""


def calibrated(spark, sf):
    th = {r["class"]: r["threshold"] for r in T.calibrate_thresholds(_pr_points(spark, sf)).collect()}
    return T.apply_thresholds(nb_scored(spark, sf), CLASSES, PCOLS, th)


@register("apply_thresholds", _apply_sql())
def q_apply_thresholds(spark, sf):
    return calibrated(spark, sf).select("o_orderkey", "predicted_calibrated")


def _gain_sql():
    inner = _apply_sql().replace("SELECT o_orderkey, CASE WHEN greatest", "SELECT actual, predicted, CASE WHEN greatest")
    macro = """(SELECT avg(CASE WHEN s + q > 0 THEN 2.0 * tp / (s + q) ELSE 0.0 END) FROM (
  SELECT c.l, (SELECT count(*) FROM ap WHERE actual = c.l AND {p} = c.l) AS tp, (SELECT count(*) FROM ap WHERE actual = c.l) AS s,
         (SELECT count(*) FROM ap WHERE {p} = c.l) AS q FROM (SELECT actual AS l FROM ap UNION SELECT {p} FROM ap) c))"""
    return f"""WITH ap AS ({inner}), m AS (SELECT {macro.format(p='predicted')} AS raw, {macro.format(p='predicted_calibrated')} AS cal)
SELECT round(raw, 9) AS raw_macro_f1, round(cal, 9) AS calibrated_macro_f1, round(cal - raw, 9) AS calibration_gain FROM m"""


@register("calibration_gain", _gain_sql())
def q_calibration_gain(spark, sf):
    df = calibrated(spark, sf)
    raw = E.classification_metrics(E.confusion(df, "actual", "predicted")).select(F.col("macro_f1").alias("raw"))
    cal = E.classification_metrics(E.confusion(df, "actual", "predicted_calibrated")).select(F.col("macro_f1").alias("cal"))
    return raw.crossJoin(cal).select(F.round("raw", 9).alias("raw_macro_f1"), F.round("cal", 9).alias("calibrated_macro_f1"),
                                     F.round(F.col("cal") - F.col("raw"), 9).alias("calibration_gain"))


# ------------------------------------------------------------------ out-of-time stability (M7)

OOT_CUT = "1998-01-01"


def _oot_sql():
    pre = f"(SELECT * FROM {OC} WHERE o_orderdate < TIMESTAMP '{OOT_CUT}')"
    hold = random_holdout_ctes("h", pre, "o_orderkey", 0.2, 42)
    tr = f"SELECT p.* FROM {pre} p JOIN h ON p.o_orderkey = h.o_orderkey WHERE h.is_test = 0"
    te_in = f"SELECT p.* FROM {pre} p JOIN h ON p.o_orderkey = h.o_orderkey WHERE h.is_test = 1"
    te_out = f"SELECT * FROM {OC} WHERE o_orderdate >= TIMESTAMP '{OOT_CUT}'"

    def f1_of(sfx):
        return f"""f1{sfx} AS (
  WITH cells AS (SELECT actual AS a, predicted AS p, count(*) AS n FROM sc{sfx} GROUP BY 1, 2),
  cls AS (SELECT a AS class FROM cells UNION SELECT p FROM cells),
  pc AS (SELECT class,
     coalesce((SELECT sum(n) FROM cells WHERE a = class AND p = class), 0) AS tp,
     coalesce((SELECT sum(n) FROM cells WHERE a = class), 0) AS s,
     coalesce((SELECT sum(n) FROM cells WHERE p = class), 0) AS q FROM cls),
  pm AS (SELECT CASE WHEN q > 0 THEN tp / q ELSE 0.0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS rc FROM pc)
  SELECT avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) AS f1 FROM pm)"""

    return f"""WITH {hold},{nb_ctes('_in', tr, te_in, FEATS)},{nb_ctes('_out', tr, te_out, FEATS)},
{f1_of('_in')}, {f1_of('_out')}
SELECT round(f1_in.f1, 9) AS in_time_f1, round(f1_out.f1, 9) AS out_of_time_f1,
       round(f1_out.f1 - f1_in.f1, 9) AS delta,
       CASE WHEN abs(f1_out.f1 - f1_in.f1) < 0.08 THEN 'STABLE' ELSE 'DROP' END AS status
FROM f1_in, f1_out"""


@register("oot_stability", _oot_sql())
def q_oot_stability(spark, sf):
    df = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderdate", *FEATS)
    pre = df.where(F.col("o_orderdate") < F.lit(OOT_CUT).cast("timestamp_ntz"))
    post = df.where(F.col("o_orderdate") >= F.lit(OOT_CUT).cast("timestamp_ntz"))
    held = S.split(pre, "o_orderkey", "random", 0.2, 42)
    model = M.fit_gaussian_nb(held.where("split = 'train'"), FEATS, "o_orderstatus")

    def f1(part):
        s = M.predict_gaussian_nb(part.withColumnRenamed("o_orderstatus", "actual"), model)
        return E.classification_metrics(E.confusion(s, "actual", "predicted")).select("macro_f1")

    a = f1(held.where("split = 'test'").drop("split")).select(F.col("macro_f1").alias("i"))
    b = f1(post).select(F.col("macro_f1").alias("o"))
    d = F.col("o") - F.col("i")
    return a.crossJoin(b).select(F.round("i", 9).alias("in_time_f1"), F.round("o", 9).alias("out_of_time_f1"),
                                 F.round(d, 9).alias("delta"), T.stability(d).alias("status"))


# ------------------------------------------------------------------ bootstrap (rows-only)


@register("bootstrap_ci")
def q_bootstrap_ci(spark, sf):
    cells = E.confusion(nb_scored(spark, sf), "actual", "predicted")
    return T.bootstrap_ci(cells, n_boot=2000, seed=42)


__all__ = ["NB_SQL", "TR", "TE"]
