"""Fits that draw rows at random, deep trees, and folds dealt once for several models."""

from pyspark.sql import functions as F

from tablier.operators import estimators as K
from tablier.operators import workflows as WF


def _rows(spark, n):
    df = spark.range(0, n, 1, 2).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3 == 1).cast("double").alias("label"))
    return K.assemble(df, ["x"])


def test_equal_rows_become_bundles_of_all_their_weight(spark):
    """each round read every row, however many were equal."""
    rows = _rows(spark, 3001)
    made = K.bundled(rows, "features", "label", bundles=40)
    by = {r["x"]: r for r in made.groupBy(F.element_at(K.vector_to_array("features"), 1).alias("x")).agg(
        F.count("*").alias("n"), F.sum("_n").alias("w"), F.min("_n").alias("lo"), F.max("_n").alias("hi")).collect()}
    assert {x: (r["n"], r["w"], r["lo"], r["hi"]) for x, r in by.items()} == {
        0.0: (40, 1001.0, 25.0, 26.0), 1.0: (40, 1000.0, 25.0, 25.0), 2.0: (40, 1000.0, 25.0, 25.0)}
    two = K.bundled(rows.withColumn("w", F.col("label") + 0.5), "features", "label", "w", bundles=40)
    assert abs(two.agg(F.sum("_n")).first()[0] - (2001 * 0.5 + 1000 * 1.5)) < 1e-9
    assert K.bundled(rows, "features", "label", bundles=600) is None
    assert K.bundled(rows.limit(0), "features", "label") is None


def test_xgboost_is_fitted_on_bundles(spark, monkeypatch):
    """the rows that reach the boosting rounds stay few, and the rule is learned."""
    fits, cached = [], K._fit_cached
    monkeypatch.setattr(K, "_fit_cached", lambda est, rows: (fits.append(rows.count()), cached(est, rows))[1])
    rows = _rows(spark, 30_000)
    fitted = K.fit_model("xgboost", rows, n_classes=2, params={"n_estimators": 3})
    assert fits == [12_000]
    assert K.score(fitted, rows.limit(300)).where("prediction <> label").isEmpty()


def test_deep_trees_keep_the_nodes_of_rows(spark):
    """each level took all rows down every tree from its root; the trees are the same."""
    rows = K.assemble(spark.range(0, 2000, 1, 4).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 7 % 13).cast("double").alias("b"), (F.col("id") * 31 % 7 % 2).cast("double").alias("label"),
    ), ["a", "b"]).cache()
    for name in ("decision_tree", "random_forest", "extra_trees"):
        spec = K.configured(name, {"n_estimators": 3} if name != "decision_tree" else None)
        est = K.make_estimator(spec, 2, 2000.0)
        assert est.getCacheNodeIds()
        kept, walked = est.fit(rows), est.copy({est.cacheNodeIds: False}).fit(rows)
        assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]
    rows.unpersist()


def test_folds_are_dealt_once_for_several_models(spark, monkeypatch):
    """every model dealt the rows to the same folds anew."""
    rows = _rows(spark, 300).withColumn("id", F.monotonically_increasing_id())
    dealt, deal = [], WF.S.kfold_stratified
    monkeypatch.setattr(WF.S, "kfold_stratified", lambda *a: (dealt.append(1), deal(*a))[1])
    folds = WF.stratified_folds(rows, "id", 3, 42)
    made = [WF.cross_validate(rows, "id", m, 3, 42, folds=folds).drop("model") for m in ("decision_tree", "gaussian_nb")]
    assert dealt == [1]
    assert all(t.count() == 3 and t.where("accuracy <> 1").isEmpty() for t in made)
