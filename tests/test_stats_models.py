"""Statistics, artifacts, estimators and streaming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablier.operators import artifacts as A
from tablier.operators import estimators as K
from tablier.operators import evaluate as E
from tablier.operators import gate as G
from tablier.operators import stats as T
from tablier.operators import workflows as WF


def test_vif_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[:, 2] = x[:, 0] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = dict(T.vif(df, ["a", "b", "c"]))
    g = x.T @ x
    inv = np.linalg.inv(g)
    for i, c in enumerate("abc"):
        assert abs(got[c] - g[i, i] * inv[i, i]) < 1e-6 * got[c]


def test_cramers_v_perfect_association(spark):
    rows = [("x" if i % 2 else "y", "p" if i % 2 else "q") for i in range(200)]
    df = spark.createDataFrame(rows, "f string, t string")
    v = T.cramers_v(df, ["f"], "t").collect()[0]["cramers_v"]
    assert v == 1.0


def test_mcnemar_statistic(spark):
    rows = [(i, 1, 1 if i < 30 else 0, 1 if i >= 20 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, actual int, m1 int, m2 int")
    r = T.mcnemar(df, "k", "actual", ["m1", "m2"]).collect()[0]
    b, c = r["b"], r["c"]
    assert (b, c) == (20, 30)
    assert abs(r["chi2"] - (abs(b - c) - 1) ** 2 / (b + c)) < 1e-12
    p = df.sparkSession.range(1).select(T.chi2_sf_1(F.lit(r["chi2"])).alias("p")).collect()[0]["p"]
    assert abs(p - math.erfc(math.sqrt(r["chi2"] / 2))) < 1e-12


def test_bootstrap_is_deterministic_and_brackets_observed(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 3) for i in range(300)], "actual int, predicted int")
    cells = E.confusion(df, "actual", "predicted")
    a = {r["statistic"]: r for r in T.bootstrap_ci(cells, n_boot=200, seed=1).collect()}
    b = {r["statistic"]: r for r in T.bootstrap_ci(cells, n_boot=200, seed=1).collect()}
    assert a == b
    for r in a.values():
        assert r["lo"] <= r["observed"] + 1e-9 and r["observed"] - 1e-9 <= r["hi"] and r["replicates"] == 200


def test_thresholds_fallback_to_argmax(spark):
    df = spark.createDataFrame([(0.2, 0.3, 0.5), (0.6, 0.3, 0.1)], "p0 double, p1 double, p2 double")
    out = T.apply_thresholds(df, ["0", "1", "2"], ["p0", "p1", "p2"], {"0": 0.9, "1": 0.9, "2": 0.9}).collect()
    assert [r["predicted_calibrated"] for r in out] == ["2", "0"]
    out = T.apply_thresholds(df, ["0", "1", "2"], ["p0", "p1", "p2"], {"0": 0.5, "1": 0.1, "2": 0.6}).collect()
    assert [r["predicted_calibrated"] for r in out] == ["1", "1"]  # margins (-.3,.2,-.1) and (.1,.2,-.5)


def _binary_frame(spark, n=120):
    rows = [(i, float(i % 7), float((i * 3) % 5), float(int(i % 7 > 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, x1 double, x2 double, label double")
    return K.assemble(df, ["x1", "x2"])


def test_train_many_isolates_failures(spark):
    df = _binary_frame(spark)
    out = {r["model"]: r for r in WF.train_many(df, df, ["logistic_regression", "decision_tree", "nope"]).collect()}
    assert out["logistic_regression"]["status"] == "trained" and out["decision_tree"]["status"] == "trained"
    assert out["nope"]["status"] == "skipped"


def test_scores_are_class_aligned_probabilities(spark):
    df = _binary_frame(spark)
    for model in ("logistic_regression", "random_forest", "adaboost"):
        f = K.fit_model(model, df, "label", "features")
        rows = K.score(f, df).select("proba").collect()
        assert all(len(r["proba"]) == 2 and abs(sum(r["proba"]) - 1) < 1e-6 for r in rows)


def test_cross_validation_folds(spark):
    df = _binary_frame(spark)
    cv = WF.cross_validate(df, "k", "logistic_regression", 3, 42).collect()
    assert sorted(r["fold"] for r in cv) == [0, 1, 2]
    summ = {r["metric"]: r for r in WF.cv_summary(WF.cross_validate(df, "k", "decision_tree", 3, 42)).collect()}
    assert summ["accuracy"]["folds"] == 3


def test_saved_gate_requires_confirmed_columns(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a")], "x double, y string")
    cfg = G.GateConfig(target="y", features=["x"])
    issues = A.run_saved_gate(spark, df, cfg, str(tmp_path / "nothing")).collect()
    assert [(i["level"], i["category"]) for i in issues] == [("fatal", "configuration")]


def test_stream_scoring_matches_batch(spark, sf001):
    import __spark_entry__ as entry

    q = entry.queries()
    a = sorted(tuple(r) for r in q["stream_scoring"](spark, sf001).collect())
    b = sorted(tuple(r) for r in q["gaussian_nb"](spark, sf001).collect())
    assert a == b and len(a) > 0
