"""Estimator and workflow queries.

Iterative learners have no SQL form: these keys are rows-only checks, with
invariants covered by pytest.  ``linear_regression_ml`` is closed-form and
has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators as K
from ..operators import imbalance as H
from ..operators import preprocess as P
from ..operators import split as S
from ..operators import stats as T
from ..operators import workflows as WF
from ..operators.running import spread
from ..operators.smote import neighbours, smote
from ..session import cut_lineage
from ..sources.tables import labels_documents, table
from .registry import register

LD_FEATURES = ["n_chars", "lang", "source"]


def ld_frame(spark, sf, target="quality"):
    """labels x documents -> (doc_id, source, label, features, split)."""
    df = labels_documents(spark, sf).select("doc_id", target, *LD_FEATURES)
    df = S.split(df, "doc_id", "stratified", 0.2, 42, target=target)
    p = P.fit(df.where("split = 'train'"), LD_FEATURES, target=target, scale=True)
    out = P.transform(df, p, keep=["doc_id", "split", "source"], as_vector=True)
    # every fold / model re-reads this frame: cut the lineage once (reliable checkpoint)
    return cut_lineage(spread(out.withColumnRenamed("source", "grp"), df.count(), 200)), p


def emb_frame(spark, sf):
    df = table(spark, sf, "embeddings")
    df = S.split(df, "vec_id", "stratified", 0.2, 42, target="label")
    out = K.assemble(df, ["embedding"]).select("vec_id", F.col("label").cast("double").alias("label"), "features", "split")
    return cut_lineage(spread(out, df.count(), 600))


def _fit_eval(spark, sf, model, frame="ld"):
    data, _ = ld_frame(spark, sf) if frame == "ld" else (emb_frame(spark, sf), None)
    train = data.where("split = 'train'").cache()
    fitted = K.fit_model(model, train, "label", "features", 42)
    m = WF.metrics_row(K.score(fitted, data.where("split = 'test'")), "label")
    return m.withColumn("model", F.lit(model))


@register("logistic_regression")
def q_logistic_regression(spark, sf):
    data, p = ld_frame(spark, sf)
    fitted = K.fit_model("logistic_regression", data.where("split = 'train'"), "label", "features")
    return K.coefficients(spark, fitted, p.output_names, p.classes)


def _importances(spark, sf, model):
    data, p = ld_frame(spark, sf)
    fitted = K.fit_model(model, data.where("split = 'train'"), "label", "features")
    return K.importances(spark, fitted, p.output_names)


@register("random_forest")
def q_random_forest(spark, sf):
    return _importances(spark, sf, "random_forest")


@register("extra_trees")
def q_extra_trees(spark, sf):
    return _importances(spark, sf, "extra_trees")


@register("decision_tree")
def q_decision_tree(spark, sf):
    return _importances(spark, sf, "decision_tree")


@register("gbt_xgboost")
def q_gbt_xgboost(spark, sf):
    return _fit_eval(spark, sf, "xgboost")


@register("gbt_gradient_boosting")
def q_gbt_gradient_boosting(spark, sf):
    return _fit_eval(spark, sf, "gradient_boosting")


@register("gbt_hist")
def q_gbt_hist(spark, sf):
    return _fit_eval(spark, sf, "hist_gradient_boosting")


@register("adaboost")
def q_adaboost(spark, sf):
    return _fit_eval(spark, sf, "adaboost")


@register("svc_rff")
def q_svc_rff(spark, sf):
    return _fit_eval(spark, sf, "svc", frame="emb")


@register("mlp")
def q_mlp(spark, sf):
    return _fit_eval(spark, sf, "neural_net", frame="emb")


@register("rf_regressor")
def q_rf_regressor(spark, sf):
    from ..operators import evaluate as E

    part = table(spark, sf, "part")
    data = K.assemble(part, ["p_size"]).withColumnRenamed("p_retailprice", "label").select("p_partkey", "label", "features")
    data = S.split(data, "p_partkey", "random", 0.2, 42)
    data = spread(data, part.count(), 200)
    fitted = K.fit_model("random_forest_regressor", data.where("split = 'train'"), "label", "features")
    scored = fitted.model.transform(data.where("split = 'test'"))
    return E.regression_metrics(scored, "label", "prediction")


@register("linear_regression_ml", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept
FROM lineitem""")
def q_linear_regression_ml(spark, sf):
    li = table(spark, sf, "lineitem")
    data = K.assemble(li, ["l_quantity"]).withColumnRenamed("l_extendedprice", "label")
    fitted = K.fit_model("linear_regression", data, "label", "features")
    m = fitted.model
    return spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 6).alias("slope"),
                                 F.round(F.lit(float(m.intercept)), 6).alias("intercept"))


@register("cv_scores")
def q_cv_scores(spark, sf):
    data, _ = ld_frame(spark, sf)
    return WF.cross_validate(data.where("split = 'train'"), "doc_id", "logistic_regression", 5, 42)


@register("cv_summary")
def q_cv_summary(spark, sf):
    return WF.cv_summary(q_cv_scores(spark, sf))


@register("group_cv_oof")
def q_group_cv_oof(spark, sf):
    data, _ = ld_frame(spark, sf)
    return WF.group_cv_oof(data, "doc_id", "grp", "logistic_regression", 5, 42).select("doc_id", "label", "fold", "prediction")


@register("stacking")
def q_stacking(spark, sf):
    data, _ = ld_frame(spark, sf)
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    return WF.stacking(train, test, "doc_id", "grp", ["logistic_regression", "decision_tree", "random_forest"], 0, 3, 42)


@register("learning_curve")
def q_learning_curve(spark, sf):
    data, _ = ld_frame(spark, sf)
    return WF.learning_curve(data, "doc_id", "grp", "logistic_regression", k=3)


@register("sensitivity")
def q_sensitivity(spark, sf):
    """M9: SMOTE to three minority ratios, retrain, compare test macro-F1."""
    base = labels_documents(spark, sf).select("doc_id", "quality", "n_chars", "lang", "source")
    base = cut_lineage(S.split(base, "doc_id", "stratified", 0.2, 42, target="quality"))
    train, test = base.where("split = 'train'").drop("split"), base.where("split = 'test'").drop("split")
    counts = H.class_counts(train, "quality")
    minority = H.minority_class(counts)
    k = H.validated_k(counts, {minority: counts[minority]}, 5, auto=False)
    # neighbours depend on the training rows only: one exact k-NN pass serves every ratio
    nn = cut_lineage(neighbours(train, "doc_id", "quality", ["n_chars"], [minority], k, 42, ["lang", "source"]))
    scores = []
    for ratio in (0.3, 0.5, 0.7):
        targets = H.custom_targets(counts, {minority: ratio})
        bal = cut_lineage(smote(train, "doc_id", "quality", ["n_chars"], targets, k, 42, nominal=True,
                                categorical=["lang", "source"], nn=nn))
        p = P.fit(bal, LD_FEATURES, target="quality")
        tr = P.transform(bal, p, as_vector=True)
        te = P.transform(test, p, as_vector=True)
        fitted = K.fit_model("logistic_regression", tr, "label", "features")
        f1 = WF.metrics_row(K.score(fitted, te), "label").collect()[0]["macro_f1"]
        scores.append((ratio, float(f1)))
    status = T.sensitivity_status([s for _, s in scores])
    return spark.createDataFrame([(r, s, status) for r, s in scores], "ratio double, macro_f1 double, status string")


@register("train_many")
def q_train_many(spark, sf):
    data, _ = ld_frame(spark, sf)
    models = ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "gaussian_nb", "no_such_model"]
    return WF.train_many(data.where("split = 'train'"), data.where("split = 'test'"), models)


@register("predictions_table")
def q_predictions_table(spark, sf):
    data, p = ld_frame(spark, sf)
    fitted = K.fit_model("logistic_regression", data.where("split = 'train'"), "label", "features")
    return WF.predictions_table(K.score(fitted, data.where("split = 'test'")), "doc_id", p.classes)


@register("row_cap_sample", """
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn
FROM orders) WHERE rn <= 3000""")
def q_row_cap_sample(spark, sf):
    return K.row_cap(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 3000, 42)
