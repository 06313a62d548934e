"""Loader, profile, preprocessing and rebalancing on the literal fixtures."""

import pytest

from tablier.functions.missing import normalize_missing
from tablier.operators import columns as C
from tablier.operators import imbalance as H
from tablier.operators import preprocess as P
from tablier.operators import profile as B
from tablier.operators.quantile import exact_median, order_statistics
from tablier.sources import loader


def test_null_markers_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('a,b,c\nnull,N/A,""\nnan, ,value\nNone,NA,text\n')
    df = loader.load_dataset(spark, str(p))
    missing = sum(1 for r in df.collect() for v in r if v is None)
    assert missing == 7


def test_latin1_fallback(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("name,city\nAndré,Montréal\n".encode("latin1"))
    assert loader.load_dataset(spark, str(p)).collect()[0]["name"] == "André"


def test_unsupported_and_missing(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported dataset format"):
        loader.load_dataset(spark, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError, match="does not exist"):
        loader.load_dataset(spark, str(tmp_path / "nope.csv"))


def test_profile_small(spark):
    df = spark.createDataFrame(
        [(1, 10.5, "a", "2026-01-01"), (2, None, "b", "2026-01-02"), (2, None, "b", "2026-01-02")],
        "id long, score double, label string, event_date string",
    )
    s = B.dataset_summary(df).collect()[0]
    assert s["duplicate_rows"] == 1
    assert round(s["total_missing_percent"], 2) == 16.67
    assert s["numeric_percent"] == 50.0 and s["categorical_percent"] == 25.0
    prof = {r["column"]: r for r in B.column_profile(df).collect()}
    assert prof["event_date"]["simplified_type"] == "Date/Time"
    assert prof["label"]["simplified_type"] == "Categorical"


def test_value_frequencies_include_missing(spark):
    df = spark.createDataFrame([("A",), ("B",), ("A",), (None,)], "category string")
    rows = B.value_frequencies(df, "category").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("A", 2), (None, 1), ("B", 1)]
    meta = B.encoding_metadata(df, "category").collect()[0]
    assert meta["unique_count"] == 2 and meta["missing_count"] == 1 and meta["first_values"] == ["A", "B"]


def test_preview_page_bounds(spark):
    df = spark.range(100_000).withColumnRenamed("id", "value")
    page = B.preview_page(df, ["value"], page=2, page_size=500).collect()
    assert len(page) == 200 and page[0]["value"] == 400
    assert B.page_count(100_000, 500) == 500


MIXED = [(20, "Austin", 1.0, "no"), (30, "Dallas", 2.0, "yes"), (40, "Austin", 3.0, "no")]
SCHEMA = "age long, city string, score double, target string"


def test_one_hot_and_target_encoding(spark):
    df = spark.createDataFrame(MIXED, SCHEMA)
    p = P.fit(df, ["age", "city", "score"], target="target")
    assert p.output_names == ["age", "score", "city_Austin", "city_Dallas"]
    new = spark.createDataFrame([(50, "San Marcos", 4.0, "no")], SCHEMA)
    row = P.transform(new, p).collect()[0]
    assert row["city_Austin"] == 0.0 and row["city_Dallas"] == 0.0
    enc = spark.createDataFrame([("b",), ("a",), ("b",)], "t string")
    classes = P.target_classes(enc, "t")
    assert [r[0] for r in enc.select(P.encode_target_expr("t", classes)).collect()] == [1.0, 0.0, 1.0]


def test_missing_features_fill(spark):
    rows = [(20, "Austin", 1.0, "no"), (None, None, None, "yes"), (40, "Austin", 3.0, "no")]
    df = spark.createDataFrame(rows, SCHEMA)
    p = P.fit(df, ["age", "city", "score"], target="target")
    assert "city_Unknown" in p.output_names
    assert p.impute["age"] == 30.0 and p.impute["score"] == 2.0
    with pytest.raises(ValueError, match="missing required feature"):
        P.transform(df.drop("city"), p)


def test_auto_features(spark):
    df = spark.createDataFrame([(1, 30, "2026-01-01", "s", "g", 0, "y")],
                               "id long, age long, visit_date string, site string, subgroup string, ignore_me long, target string")
    feats = C.resolve_features(df, "target", id_columns=["id"], excluded=["ignore_me"], subgroup="subgroup",
                               group="site", date="visit_date")
    assert feats == ["age"]


def test_exact_median_and_order_statistics(spark):
    df = spark.range(1, 1002).selectExpr("cast(id as double) as x")
    assert exact_median(df, "x") == 501.0
    import tablier.operators.quantile as Q

    old = Q.EXACT_ROWS
    Q.EXACT_ROWS = 50  # force the bracketing path
    try:
        st = order_statistics(df, "x", [1, 250, 1001])
        assert st == {1: 1.0, 250: 250.0, 1001: 1001.0}
        heavy = spark.range(3000).selectExpr("cast(case when id < 2000 then 7 else id end as double) as x")
        assert exact_median(heavy, "x") == 7.0
    finally:
        Q.EXACT_ROWS = old


def test_standard_scale_zero_variance(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    p = P.fit(df, ["x"], scale=True)
    assert [r["x"] for r in P.transform(df, p, with_label=False).collect()] == [0.0, 0.0]


def test_task_type(spark):
    assert P.task_rule(100, 3, 0, True) == "classification"
    assert P.task_rule(100, 90, 0, False) == "regression"
    df = spark.createDataFrame([(float(i) / 7,) for i in range(200)], "y double")
    assert P.detect_task_type(df, "y") == "regression"
    with pytest.raises(ValueError, match="must be numeric"):
        P.check_regression_target(spark.createDataFrame([("low",), ("high",)], "t string"), "t")


def _imb(spark, a, b):
    rows = [(i, i, "a" if i % 2 else "b", 0) for i in range(a)] + [(a + i, a + i, "a", 1) for i in range(b)]
    return spark.createDataFrame(rows, "row_id long, feature long, category string, target int")


def test_class_weights(spark):
    df = _imb(spark, 8, 2)
    out, info = H.apply_strategy(df, "row_id", "target", "class_weight")
    w = info.class_weights
    assert w["0"] < w["1"] and out.count() == 10


def test_over_and_under_sampling(spark):
    df = _imb(spark, 16, 4)
    over, _ = H.apply_strategy(df, "row_id", "target", "random_oversample")
    assert H.class_counts(over, "target") == {"0": 16, "1": 16}
    under, _ = H.apply_strategy(df, "row_id", "target", "random_undersample")
    assert H.class_counts(under, "target") == {"0": 4, "1": 4}


def test_custom_targets_training_only(spark):
    df = _imb(spark, 7, 3)
    counts = H.class_counts(df, "target")
    targets = H.training_only({"1": 7, "2": 7}, counts)
    assert targets == {"1": 7}
    with pytest.raises(ValueError, match="Unknown class"):
        H.custom_targets(counts, {"9": 2})


def test_smote_k_validation(spark):
    df = _imb(spark, 9, 1)
    out, info = H.apply_strategy(df, "row_id", "target", "smote", features=["feature"])
    assert info.success is False and out.count() == 10
    with pytest.raises(ValueError, match="Unsupported imbalance_method"):
        H.apply_strategy(df, "row_id", "target", "magic")


def test_loader_markers_on_frame(spark):
    df = spark.createDataFrame([(" NA ", float("nan")), ("x", 1.0)], "a string, b double")
    rows = normalize_missing(df).collect()
    assert rows[0]["a"] is None and rows[0]["b"] is None and rows[1]["a"] == "x"
