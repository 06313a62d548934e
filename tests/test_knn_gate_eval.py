"""k-NN exactness across Voronoi cells, quality-gate fixtures, evaluation fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablier.operators import evaluate as E
from tablier.operators import gate as G
from tablier.operators import knn as K


def test_knn_multi_cell_matches_brute_force(spark, sf001):
    df = spark.read.parquet(f"{sf001}/embeddings.parquet")
    old = K.CELL_TARGET
    K.CELL_TARGET = 7  # many cells per class: the cross-cell bound must find the rest
    try:
        got = K.knn_within_groups(df, "vec_id", "label", "embedding", 4, 42).collect()
    finally:
        K.CELL_TARGET = old
    pdf = df.toPandas()
    exp = {}
    for lab, sub in pdf.groupby("label"):
        v = np.array(sub["embedding"].tolist(), dtype=float)
        keys = sub["vec_id"].astype(str).tolist()
        d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
        for i, q in enumerate(keys):
            order = sorted((d[i, j], keys[j]) for j in range(len(keys)) if j != i)[:4]
            exp[q] = [kk for _, kk in order]
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append((r["nn_rank"], r["nn_key"]))
    assert {q: [k for _, k in sorted(v)] for q, v in by.items()} == exp


def _report(spark, df, **kw):
    cfg = G.GateConfig(**kw)
    return G.run_gate(spark, df, cfg).collect()


def test_gate_target_markers(spark):
    vals = [None, "", "   ", "NA", "N/A", "null", "None"] + ["a" if i % 2 else "b" for i in range(93)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "feature long, target string")
    issues = _report(spark, df, target="target", features=["feature"], split_method="random")
    msgs = [i["message"] for i in issues if i["category"] == "target" and i["level"] == "error"]
    assert "Column 'target' contains 7 empty values (7.0%). Please clean this column before training." in msgs


def test_gate_missing_numeric_nan(spark):
    rows = [(float(i), i % 2) for i in range(99)] + [(float("nan"), 1)]
    df = spark.createDataFrame(rows, "feature double, target int")
    issues = _report(spark, df, target="target", features=["feature"], split_method="random")
    assert any("contains 1 empty values (1.0%)" in i["message"] for i in issues)


def test_gate_warnings_only_can_continue(spark):
    rows = [(i, "same", 1 if i < 2 else 0) for i in range(30)]
    df = spark.createDataFrame(rows, "feature long, constant string, target int")
    issues = G.run_gate(spark, df, G.GateConfig(target="target", features=["feature"], split_method="random"))
    r = G.rollup(issues).collect()[0]
    assert r["errors"] == 0 and r["fatals"] == 0 and r["warnings"] >= 2 and r["can_continue"]
    msgs = [i["message"] for i in issues.collect()]
    assert "Constant columns found: ['constant']." in msgs
    assert "ID-like columns are selected as features: ['feature']." in msgs


def test_gate_time_coverage_fatal(spark):
    ys = [0, 0, 0, 0, 1, 1, 1, 0, 0, 2]
    rows = [(i, y, dt.datetime(2026, 1, 1) + dt.timedelta(days=i)) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "feature long, target int, event_date timestamp")
    cfg = G.GateConfig(target="target", features=["feature"], key="feature", split_method="time", date_column="event_date")
    issues = G.run_gate(spark, df, cfg, ("coverage",)).collect()
    fatal = [i for i in issues if i["level"] == "fatal"]
    warn = [i for i in issues if i["level"] == "warning"]
    assert len(fatal) == 1 and "Class '2'" in fatal[0]["message"]
    assert sum("Class '1'" in i["message"] for i in warn) == 2


def test_gate_rare_class_stratified(spark):
    rows = [(i, 0) for i in range(10)] + [(10, 1), (11, 1)]
    df = spark.createDataFrame(rows, "feature long, target int")
    issues = _report(spark, df, target="target", features=["feature"], split_method="stratified")
    assert any(i["message"].startswith("Class '1' has only 2 samples.") for i in issues)


def test_gate_empty_dataset(spark):
    df = spark.createDataFrame([], "feature long, target int")
    issues = _report(spark, df, target="target", features=["feature"])
    assert [(i["level"], i["message"]) for i in issues] == [("fatal", "The dataset is empty.")]


def test_gate_row_cap_and_readiness(spark):
    df = spark.range(3001).select(F.col("id").alias("feature"), (F.col("id") % 2).alias("target"))
    cfg = G.GateConfig(target="target", features=["feature"], selected_models=["foundation"],
                       row_capped_models={"foundation": 3000}, split_method="random")
    issues = G.run_gate(spark, df, cfg)
    assert any(i["category"] == "model" for i in issues.collect())
    ready = G.readiness(issues).collect()[0]
    assert ready["training"] and ready["score"] == "6 / 6 checks passed"


def test_issue_level_validation():
    with pytest.raises(ValueError, match="Invalid issue level"):
        G.Report("t").add("bogus", "x", "m", "s")


def test_accuracy_three_of_four(spark):
    df = spark.createDataFrame([(0, 0, 0.9, 0.1), (1, 1, 0.2, 0.8), (1, 0, 0.6, 0.4), (0, 0, 0.7, 0.3)],
                               "actual int, predicted int, p0 double, p1 double")
    m = E.classification_metrics(E.confusion(df, "actual", "predicted")).collect()[0]
    assert m["accuracy"] == 0.75
    counts = E.score_counts(df, "actual", ["0", "1"], ["p0", "p1"], positive_only=True)
    auc = E.roc_auc(counts).collect()[0]["roc_auc"]
    assert auc == 1.0


def test_auc_with_ties_matches_rank_formula(spark):
    scores = [0.1, 0.4, 0.4, 0.4, 0.8, 0.8, 0.9]
    labels = [0, 0, 1, 1, 0, 1, 1]
    df = spark.createDataFrame([(y, 1 - s, s) for y, s in zip(labels, scores)], "actual int, p0 double, p1 double")
    counts = E.score_counts(df, "actual", ["0", "1"], ["p0", "p1"], positive_only=True)
    got = E.roc_auc(counts).collect()[0]["roc_auc"]
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12
    roc = E.roc_curve(counts).orderBy("fpr", "tpr").collect()
    assert roc[0]["threshold"] == float("inf") and roc[-1]["fpr"] == 1.0 and roc[-1]["tpr"] == 1.0
    assert all(abs(r["auc"] - exp) < 1e-12 for r in roc)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2)], "actual double, predicted double")
    m = E.regression_metrics(df, "actual", "predicted").collect()[0]
    assert abs(m["mae"] - 0.4 / 3) < 1e-12
    assert abs(m["r2"] - (1 - 0.06 / 2.0)) < 1e-12


def test_macro_curve_interpolates(spark):
    rows = [("a", 0.0, 0.0), ("a", 0.5, 1.0), ("a", 1.0, 1.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "class string, fpr double, tpr double")
    m = {r["grid_index"]: r["tpr"] for r in E.macro_curve(df, "fpr", "tpr").collect()}
    assert len(m) == 201
    assert abs(m[50] - (0.5 + 0.25) / 2) < 1e-12 and m[200] == 1.0


def test_curves_identical_across_bucket_layouts(spark):
    import random

    rnd = random.Random(7)
    rows = [(rnd.randint(0, 2), *(lambda a, b: (a, b, max(0.0, 1 - a - b)))(round(rnd.random() / 2, 2), round(rnd.random() / 2, 2)))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "actual int, p0 double, p1 double, p2 double")
    counts = E.score_counts(df, "actual", ["0", "1", "2"], ["p0", "p1", "p2"])

    def snap():
        roc = sorted(tuple(round(v, 12) for v in (r["fpr"], r["tpr"], r["threshold"], r["auc"])) + (r["class"],)
                     for r in E.roc_curve(counts).collect())
        pr = sorted(tuple(round(v, 12) for v in (r["recall"], r["precision"], r["threshold"], r["average_precision"])) + (r["class"],)
                    for r in E.pr_curve(counts).collect())
        return roc, pr

    one = snap()
    old = E.ROWS_PER_BUCKET
    E.ROWS_PER_BUCKET = 3  # dozens of buckets per class: exercises offsets and bucket-edge neighbours
    try:
        many = snap()
    finally:
        E.ROWS_PER_BUCKET = old
    assert one == many
