"""Learners and workflows on a target with a known rule, so that SQL can state every row.

The class of a customer is a rule over the market segment, so each learner must
give the rule back on rows it has not seen, and each workflow must score 1.
Which rows are held out, their folds and the group samples are the seeded ones
that the split oracles state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators as K
from ..operators import imbalance as H
from ..operators import preprocess as P
from ..operators import split as S
from ..operators import stats as T
from ..operators import workflows as WF
from ..operators.running import spread, written
from ..sources.tables import table
from .registry import register
from .sqlgen import group_folds_ctes, md5_sql, stratified_holdout_ctes

# the rule: two segments, one segment, the other two
_RULE = "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'a' WHEN c_mktsegment = 'FURNITURE' THEN 'b' ELSE 'c' END"
_CUSTOMERS = f"(SELECT c_custkey, c_mktsegment, c_nationkey, {_RULE} AS kind FROM customer)"
_IDS = "CASE kind WHEN 'a' THEN 0.0 WHEN 'b' THEN 1.0 ELSE 2.0 END"
LEARN_BYTES = 200  # of a prepared row
HELD = stratified_holdout_ctes("h", _CUSTOMERS, "c_custkey", "kind", 0.2, 42)


def customers(spark, sf):
    """(c_custkey, c_mktsegment, c_nationkey, kind, split)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").withColumn("kind", F.expr(_RULE))
    return S.split(c, "c_custkey", "stratified", 0.2, 42, target="kind")


def prepared(spark, sf):
    """The encoded rows, written once: every model and fold reads them again."""
    df = customers(spark, sf)
    p = P.fit(df.where("split = 'train'"), ["c_mktsegment"], target="kind")
    made = P.transform(df, p, keep=["c_custkey", "c_mktsegment", "c_nationkey", "split"], as_vector=True)
    return written(spread(made, df.count(), LEARN_BYTES), "learn"), p


def _learned(spark, sf, models):
    """(model, segment, predicted, rows, whole_probabilities) over the held-out rows."""
    data, p = prepared(spark, sf)
    train, test, out = data.where("split = 'train'"), data.where("split = 'test'"), None
    for model in models:
        scored = K.score(K.fit_model(model, train, n_classes=3), test)
        total = F.aggregate("proba", F.lit(0.0), lambda a, b: a + b)
        whole = (F.size("proba") == 3) & (F.abs(total - 1) < 1e-6) & F.forall("proba", lambda x: (x >= 0) & (x <= 1 + 1e-9))
        rows = scored.groupBy("c_mktsegment", P.decode_target_expr("prediction", p.classes).alias("predicted")).agg(
            F.count("*").alias("rows"), F.bool_and(whole).alias("whole_probabilities")
        )
        rows = rows.select(F.lit(model).alias("model"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _learned_sql(models):
    names = ", ".join(f"('{m}')" for m in models)
    return f"""WITH {HELD}
SELECT model, c_mktsegment, kind AS predicted, count(*) AS rows, true AS whole_probabilities
FROM {_CUSTOMERS} c JOIN h USING (c_custkey), (VALUES {names}) AS m(model) WHERE is_test = 1 GROUP BY ALL"""


FAMILIES = {
    "learn_rule_trees": ["decision_tree", "random_forest", "extra_trees", "adaboost"],
    "learn_rule_boosted": ["gradient_boosting"],
    "learn_rule_xgboost": ["xgboost"],
    "learn_rule_linear": ["logistic_regression", "svc", "neural_net", "gaussian_nb", "knn"],
}
for _name, _models in FAMILIES.items():
    register(_name, _learned_sql(_models))(lambda spark, sf, models=_models: _learned(spark, sf, models))


@register("learn_rule_hist", """
SELECT o_orderpriority, CASE WHEN o_orderpriority LIKE '%-HIGH' THEN 1.0 ELSE 0.0 END AS predicted, count(*) AS rows FROM orders GROUP BY 1, 2""")
def q_learn_rule_hist(spark, sf):
    """K7: leaves of at least 20 rows need a larger table; two classes."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderpriority").like("%-HIGH").cast("string").alias("kind"))
    p = P.fit(o, ["o_orderpriority"], target="kind")
    data = written(spread(P.transform(o, p, keep=["o_orderpriority"], as_vector=True), o.count(), LEARN_BYTES), "learn")
    scored = K.score(K.fit_model("hist_gradient_boosting", data, n_classes=2), data)
    return scored.groupBy("o_orderpriority", F.col("prediction").alias("predicted")).agg(F.count("*").alias("rows"))


@register("learn_values", """
SELECT model, segment, round(v, 6) AS predicted, n AS rows FROM (VALUES ('linear_regression'), ('random_forest_regressor')) AS m(model),
 (SELECT c_mktsegment AS segment, length(c_mktsegment) * 2.5 + 1 AS v, count(*) AS n FROM customer GROUP BY 1, 2)""")
def q_learn_values(spark, sf):
    """A value that is linear in one discrete feature is given back exactly."""
    c = table(spark, sf, "customer").select("c_mktsegment", F.length("c_mktsegment").cast("double").alias("x"))
    data = written(spread(K.assemble(c, ["x"]).withColumn("label", F.col("x") * 2.5 + 1), c.count(), LEARN_BYTES), "learn")
    out = None
    for model in ("linear_regression", "random_forest_regressor"):
        scored = K.fit_model(model, data).model.transform(data)
        rows = scored.groupBy(F.col("c_mktsegment").alias("segment"), F.round("prediction", 6).alias("predicted")).agg(F.count("*").alias("rows"))
        rows = rows.select(F.lit(model).alias("model"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("cv_rule", """
SELECT range AS fold, 'decision_tree' AS model, 1.0 AS accuracy, 1.0 AS macro_f1, 1.0 AS weighted_f1, 1.0 AS balanced_accuracy, 1.0 AS roc_auc FROM range(5)""")
def q_cv_rule(spark, sf):
    data, _ = prepared(spark, sf)
    cv = WF.cross_validate(data, "c_custkey", "decision_tree", 5, 42)
    return cv.select(F.col("fold").cast("long").alias("fold"), "model", *[F.round(m, 9).alias(m) for m in WF.METRICS])


@register("cv_rule_summary", """
SELECT 'decision_tree' AS model, metric, 1.0 AS mean, 0.0 AS std, 5 AS folds
FROM (VALUES ('accuracy'), ('macro_f1'), ('weighted_f1'), ('balanced_accuracy'), ('roc_auc')) AS m(metric)""")
def q_cv_rule_summary(spark, sf):
    s = WF.cv_summary(q_cv_rule(spark, sf))
    return s.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


_FOLDS = group_folds_ctes("f", _CUSTOMERS, "c_nationkey", "kind", 5, 42)


def _doubled(key: str):
    """Oversampling of the training rows of a fold to the size of the largest class."""

    def rebalance(train):
        counts = H.class_counts(train, "label")
        return H.oversample(train, key, "label", H.sampling_targets(counts, "random_oversample"), 42)

    return rebalance


@register("group_cv_rule", f"""WITH {_FOLDS}
SELECT c_custkey, {_IDS} AS label, f.fold, {_IDS} AS prediction FROM {_CUSTOMERS} c JOIN f USING (c_nationkey)""")
def q_group_cv_rule(spark, sf):
    """M3 with rebalancing per fold: every row is scored once, by the model of its own fold, and none is added."""
    data, _ = prepared(spark, sf)
    oof = WF.group_cv_oof(data, "c_custkey", "c_nationkey", "decision_tree", 5, 42, rebalance=_doubled("c_custkey"))
    return oof.select("c_custkey", "label", "fold", "prediction")


@register("stacking_rule", """
SELECT 1.0 AS accuracy, 1.0 AS macro_f1, 1.0 AS weighted_f1, 1.0 AS balanced_accuracy, 'decision_tree,logistic_regression' AS bases""")
def q_stacking_rule(spark, sf):
    data, _ = prepared(spark, sf)
    made = WF.stacking(data.where("split = 'train'"), data.where("split = 'test'"), "c_custkey", "c_nationkey", ["decision_tree", "logistic_regression"], 0, 3, 42)
    return made.select(*[F.round(m, 9).alias(m) for m in WF.METRICS[:-1]], "bases")


FRACTIONS = (0.4, 0.8)


@register("learning_curve_rule", f"""
WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY {md5_sql(42, 'c_nationkey')}, c_nationkey) AS rn, count(*) OVER () AS n
           FROM (SELECT DISTINCT c_nationkey FROM customer))
SELECT fraction, count(*) AS rows, 1.0 AS macro_f1_mean, 0.0 AS macro_f1_std, 3 AS folds
FROM customer JOIN g USING (c_nationkey), (VALUES {', '.join(f'({f}::DOUBLE)' for f in FRACTIONS)}) AS f(fraction)
WHERE rn <= greatest(1, floor(n * fraction)) GROUP BY fraction""")
def q_learning_curve_rule(spark, sf):
    """M8 as the mean and deviation over the folds, with rebalancing of the training rows."""
    data, _ = prepared(spark, sf)
    curve = WF.learning_curve_folds(data, "c_custkey", "c_nationkey", "decision_tree", FRACTIONS, 3, 42, rebalance=_doubled("c_custkey"))
    return curve.select("fraction", "rows", F.round("macro_f1_mean", 9).alias("macro_f1_mean"), F.round("macro_f1_std", 9).alias("macro_f1_std"), "folds")


@register("train_many_rule", """
SELECT * FROM (VALUES ('decision_tree', 'trained', 1.0, 1.0, true), ('gaussian_nb', 'trained', 1.0, 1.0, true),
 ('no_such_model', 'skipped', NULL, NULL, false), ('neural_net', 'failed', NULL, NULL, false)) AS t(model, status, accuracy, macro_f1, has_auc)""")
def q_train_many_rule(spark, sf):
    """Trained, unknown and failing models side by side (``hidden`` must be a number)."""
    data, _ = prepared(spark, sf)
    made = WF.train_many(
        data.where("split = 'train'"), data.where("split = 'test'"), ["decision_tree", "gaussian_nb", "no_such_model", "neural_net"],
        class_weights=True, params={"neural_net": {"hidden": "many"}},
    )
    return made.select("model", "status", "accuracy", "macro_f1", F.col("roc_auc").isNotNull().alias("has_auc"))


@register("predictions_rule", f"""WITH {HELD}
SELECT c_custkey, kind AS actual, kind AS predicted, true AS first FROM {_CUSTOMERS} c JOIN h USING (c_custkey) WHERE is_test = 1""")
def q_predictions_rule(spark, sf):
    """Labels decoded; the probability of the predicted class is the largest."""
    data, p = prepared(spark, sf)
    fitted = K.fit_model("logistic_regression", data.where("split = 'train'"))
    t = WF.predictions_table(K.score(fitted, data.where("split = 'test'")), "c_custkey", p.classes)
    best = F.greatest(*[F.col(f"prob_{c}") for c in p.classes])
    own = F.coalesce(*[F.when(F.col("predicted") == c, F.col(f"prob_{c}")) for c in p.classes])
    return t.select("c_custkey", "actual", "predicted", (own == best).alias("first"))


@register("importances_rule", """
SELECT 'c_mktsegment_' || s AS feature, CASE WHEN s = 'FURNITURE' THEN 1.0 ELSE 0.0 END AS importance
FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)""")
def q_importances_rule(spark, sf):
    """One segment decides, so it has all the importance."""
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_mktsegment") == "FURNITURE").cast("string").alias("kind"))
    p = P.fit(df, ["c_mktsegment"], target="kind")
    fitted = K.fit_model("decision_tree", P.transform(df, p, as_vector=True))
    return K.importances(spark, fitted, p.output_names)


@register("coefficients_rule", """
SELECT s AS segment, s = 'FURNITURE' AS raises FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)""")
def q_coefficients_rule(spark, sf):
    """Odds ratios above one exactly for the segment that makes the positive class."""
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_mktsegment") == "FURNITURE").cast("string").alias("kind"))
    p = P.fit(df, ["c_mktsegment"], target="kind")
    fitted = K.fit_model("logistic_regression", P.transform(df, p, as_vector=True))
    t = K.coefficients(spark, fitted, p.output_names, p.classes)
    return t.select(F.regexp_replace("feature", "^c_mktsegment_", "").alias("segment"), (F.col("odds_ratio") > 1).alias("raises"))


RATIOS = ((0.3, 0.4), (0.6, 0.8))


@register("sensitivity_rule", f"""
SELECT r1 AS ratio_b, r2 AS ratio_c, 1.0 AS macro_f1, 'STABLE' AS status
FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in RATIOS)}) AS r(r1, r2)""")
def q_sensitivity_rule(spark, sf):
    """M9 with pairs of ratios: two minority classes are raised to shares of the largest, then all is trained anew."""
    data, p = prepared(spark, sf)
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    counts = H.class_counts(train, "label")
    rows = []
    for low, high in RATIOS:
        targets = H.custom_targets(counts, {"1.0": low, "2.0": high})
        made = written(H.oversample(train, "c_custkey", "label", targets, 42), "ratio")
        score = WF.metrics_row(K.score(K.fit_model("decision_tree", made, n_classes=3), test)).first()["macro_f1"]
        rows.append((low, high, round(float(score), 9)))
    status = T.sensitivity_status([s for _, _, s in rows])
    return spark.createDataFrame([(*r, status) for r in rows], "ratio_b double, ratio_c double, macro_f1 double, status string")
