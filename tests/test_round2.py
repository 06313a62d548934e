"""Faults found in review: null keys and groups, many classes, collinearity, quotes and encodings, medians."""

import math

import pytest
from pyspark.sql import functions as F

from tablier.operators import estimators as K
from tablier.operators import evaluate as E
from tablier.operators import profile as P
from tablier.operators import split as S
from tablier.operators import workflows as WF
from tablier.operators.imbalance import apply_strategy
from tablier.operators.quantile import exact_median
from tablier.operators.stats import vif
from tablier.sources.loader import read_csv_text


def test_stratified_kfold_keeps_rows_without_key(spark):
    df = spark.range(100).select(F.when(F.col("id") >= 10, F.col("id")).alias("k"), (F.col("id") % 2).alias("y"))
    assert S.kfold_stratified(df, "k", "y", 5).count() == 100


def test_group_folds_cover_rows_without_group(spark):
    df = spark.range(100).select("id", F.when(F.col("id") >= 20, F.col("id") % 12).alias("g"), (F.col("id") % 2).alias("y"))
    out = S.kfold_group(df, "y", "g", 4)
    assert out.where("fold IS NULL").count() == 0 and out.count() == 100
    assert out.where("g IS NULL").select("fold").distinct().count() == 1


def test_stratified_split_of_many_classes(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 2_500).alias("y"))
    parts = S.split_three_way(df, "id", "stratified", 50, 25, 25, 42, target="y")
    n = {r[0]: r[1] for r in parts.groupBy(parts.columns[-1]).count().collect()}
    assert sum(n.values()) == 10_000 and len(n) == 3


def test_confusion_of_many_labels(spark):
    df = spark.range(2_500).select(F.col("id").alias("a"), F.col("id").alias("p"))
    assert E.classification_metrics(E.confusion(df, "a", "p")).first()["accuracy"] == 1.0


def test_vif_of_dependent_columns(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), F.rand(1).alias("b"), (F.col("id") * 2.0).alias("c"))
    out = dict(vif(df, ["a", "b", "c"]))
    assert math.isinf(out["a"]) and math.isinf(out["c"]) and math.isfinite(out["b"])


def test_median_of_a_balanced_flag(spark):
    df = spark.range(600_000).select((F.col("id") % 2).cast("double").alias("x"))
    assert exact_median(df, "x") == 0.5


def test_signed_zero_is_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert P.column_value_counts(df).count() == 2


def test_csv_quotes_line_breaks_and_encoding_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,t\n1,"two\nlines, ""quoted"""\n2,Montréal\n'.encode())
    (tmp_path / "b.csv").write_bytes("id,t\n3,Québec\n".encode("latin-1"))
    df, _ = read_csv_text(spark, str(tmp_path))
    assert {r.id: r.t for r in df.collect()} == {"1": 'two\nlines, "quoted"', "2": "Montréal", "3": "Québec"}


def test_smote_nc_needs_categories(spark):
    df = spark.range(40).select("id", F.rand(1).alias("x"), F.when(F.col("id") < 10, "a").otherwise("b").alias("y"))
    out, info = apply_strategy(df, "id", "y", "smote_nc", features=["x"])
    assert not info.success and out.count() == 40


def _two_blobs(spark, n=300, classes=2):
    df = spark.range(n).select("id", (F.col("id") % classes).cast("double").alias("label"), (F.col("id") % 7).alias("grp"))
    xs = [(F.col("label") * (3.0 if i == 0 else -2.0) + F.randn(i + 1)).alias(f"x{i}") for i in range(2)]
    return K.cut_lineage(K.assemble(df.select("*", *xs), ["x0", "x1"]))


def test_neighbours_and_bayes_are_trained_with_user_parameters(spark):
    df = _two_blobs(spark, classes=3)
    out = WF.train_many(df, df, ["knn", "gaussian_nb", "lr", "dt"], class_weights=True,
                        params={"knn": {"n_neighbors": 1}, "lr": {"l1_ratio": 1.0}, "dt": {"depth": 3}})
    rows = {r.model: r for r in out.collect()}
    assert rows["knn"].accuracy == 1.0 and rows["gaussian_nb"].accuracy > 0.8 and rows["gaussian_nb"].roc_auc > 0.9
    assert rows["lr"].status == "trained" and rows["lr"].weighted_f1 > 0.8
    assert rows["dt"].status == "failed" and "no parameter depth" in rows["dt"].error


def test_knn_votes_are_shares_of_the_nearest(spark):
    rows = [(i, float(i), float(i >= 5)) for i in range(10)]
    df = K.assemble(spark.createDataFrame(rows, "id long, x double, label double"), ["x"])
    fitted = K.fit_model("knn", df, params={"n_neighbors": 3})
    ask = K.assemble(spark.createDataFrame([(0, 4.4), (1, 9.0)], "id long, x double"), ["x"])
    out = {r.id: r for r in K.score(fitted, ask).collect()}
    assert [round(p, 6) for p in out[0].proba] == [round(2 / 3, 6), round(1 / 3, 6)] and out[0].prediction == 0.0
    assert out[1].proba == [0.0, 1.0] and out[1].prediction == 1.0
