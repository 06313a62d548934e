"""Equal rows of a fit as one weighted row."""

import numpy as np
from pyspark.sql import functions as F

from tablier.operators import estimators as K


def _rows(spark, n):
    df = spark.range(0, n, 1, 1).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3 == 1).cast("double").alias("label"))
    return K.assemble(df, ["x"])


def test_equal_rows_are_folded_with_their_number(spark):
    """Each round read all rows, however many of them were equal."""
    rows = _rows(spark, 300)
    made = K.folded(rows, "features", "label")
    assert sorted((r["features"][0], r["label"], r["_n"]) for r in made.collect()) == [(0.0, 0.0, 100.0), (1.0, 1.0, 100.0), (2.0, 0.0, 100.0)]
    weighted = K.folded(rows.withColumn("w", F.lit(0.5)), "features", "label", "w")
    assert {r["_n"] for r in weighted.collect()} == {50.0}
    apart = K.assemble(spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("label")), ["x"])
    assert K.folded(apart, "features", "label") is None
    assert K.folded(apart.limit(0), "features", "label") is not None


def test_folded_fit_is_the_fit_of_all_rows(spark):
    """The model of many equal rows is that of the rows one by one."""
    rows = _rows(spark, 300).withColumn("label", F.when(F.rand(1) < 0.1, 1 - F.col("label")).otherwise(F.col("label"))).cache()
    asked = _rows(spark, 3)
    for model, params in (("adaboost", {"n_estimators": 4}), ("gradient_boosting", {"n_estimators": 4})):
        one = K.score(K.fit_model(model, rows, n_classes=2, params=params), asked.withColumn("at", F.element_at(K.vector_to_array("features"), 1))).orderBy("at").select("proba").collect()
        fold, K.folded = K.folded, lambda *a: None
        try:
            other = K.score(K.fit_model(model, rows, n_classes=2, params=params), asked.withColumn("at", F.element_at(K.vector_to_array("features"), 1))).orderBy("at").select("proba").collect()
        finally:
            K.folded = fold
        assert np.allclose([r["proba"] for r in one], [r["proba"] for r in other], atol=1e-9)
    rows.unpersist()
