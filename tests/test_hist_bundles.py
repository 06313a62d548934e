"""Histogram boosting on equal rows: as many bundles as a leaf must have rows, whatever their number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablier.operators import estimators as K


def _rows(spark, groups):
    """``groups``: (x, label, weight, number of rows)."""
    df = spark.createDataFrame(groups, "x double, label double, w double, n int")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).select("x", "label", "w")
    return K.assemble(df, ["x"])


def _probabilities(spark, rows, classes, weight=None):
    fitted = K.fit_model("hist_gradient_boosting", rows, weight_col=weight, n_classes=classes, params={"max_iter": 4})
    asked = K.assemble(rows.select("x").distinct(), ["x"])
    return {r["x"]: (r["prediction"], *r["proba"]) for r in K.score(fitted, asked).select("x", "prediction", "proba").collect()}


def test_few_bundles_reach_the_rounds(spark, monkeypatch):
    """each of 100 rounds read every row, however many were equal."""
    fits, fit = [], K._fit
    monkeypatch.setattr(K, "_fit", lambda name, spec, train, *a: (fits.append(train.count()), fit(name, spec, train, *a))[1])
    found = _probabilities(spark, _rows(spark, [(0.0, 0.0, 1.0, 9000), (1.0, 1.0, 1.0, 12_000), (2.0, 0.0, 1.0, 15)]), 2)
    assert fits == [55]
    assert [found[x][0] for x in (0.0, 1.0)] == [0.0, 1.0]


@pytest.mark.parametrize("rows,predicted", [(19, 0.0), (20, 1.0)])
def test_a_leaf_still_has_twenty_rows(spark, rows, predicted):
    """the rows of a leaf count, not their bundles: 19 rows get no leaf, 20 do."""
    found = _probabilities(spark, _rows(spark, [(0.0, 1.0, 1.0, rows), (1.0, 0.0, 1.0, 1000), (2.0, 1.0, 1.0, 1000)]), 2)
    assert [found[x][0] for x in (0.0, 1.0, 2.0)] == [predicted, 0.0, 1.0]


@pytest.mark.parametrize("classes,weight", [(2, None), (2, "w"), (3, None), (3, "w")])
def test_bundles_give_the_model_of_the_rows(spark, monkeypatch, classes, weight):
    """also for mixed labels, uneven weights, weight 0 and groups below and above a leaf."""
    rng = np.random.default_rng(5)
    groups = [(float(x), float(rng.integers(classes)), w, int(n)) for x in range(9) for w, n in zip((0.5, 1.0, 2.5, 0.0), rng.integers(1, 70, 4) * (1, 5, 1, 1))]
    rows = _rows(spark, groups).cache()
    fits, fit = [], K._fit
    monkeypatch.setattr(K, "_fit", lambda name, spec, train, *a: (fits.append(train.count()), fit(name, spec, train, *a))[1])
    fewer = _probabilities(spark, rows, classes, weight)
    monkeypatch.setattr(K, "bundled", lambda *a: None)
    every = _probabilities(spark, rows, classes, weight)
    assert fits[0] * 2 <= fits[1] == rows.count()
    assert all(np.allclose(fewer[x], every[x], atol=1e-9) for x in every) and len(fewer) == len(every) == 9
    rows.unpersist()


def test_many_bundles_are_of_even_size(spark):
    """where Spark draws bundles to look for cut values, none weighs more than its share of a draw."""
    rows = _rows(spark, [(float(x), 0.0, 1.0, 5) for x in range(30)] + [(99.0, 1.0, 1.0, 6000)])
    made = K.bundled(rows, "features", "label", None, 20, 100)
    heavy = made.where("label = 1").agg(F.count("*"), F.max("_n"), F.sum("_n")).first()
    assert tuple(heavy) == (98, 62.0, 6000.0) and made.where("label = 0").agg(F.count("*"), F.sum("_n")).first() == (150, 150.0)
    assert K.bundled(rows, "features", "label", None, 20, 170).count() == 170
    assert K.bundled(rows, "features", "label", None, 20).count() == 170
