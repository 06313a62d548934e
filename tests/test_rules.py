"""Every rule of the gate holds somewhere, and only there."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablier.operators import gate as G
from tablier.operators import profile as P


def messages(spark, df, checks=G.ALL_CHECKS, **settings):
    return {(r["level"], r["message"]) for r in G.run_gate(spark, df, G.GateConfig(**settings), checks).collect()}


@pytest.fixture(scope="module")
def clean(spark):
    return spark.range(400).select(
        (F.col("id") % 50 * 1.5).alias("x"), (F.col("id") % 7).alias("z"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y")
    )


def test_clean_data_has_one_known_warning(spark, clean):
    assert messages(spark, clean.dropDuplicates(), target="y", features=["x", "z"], split_method="random") == set()


CASES = [
    (("fatal", "The dataset is empty."), lambda d: d.where("false"), {}),
    (("error", "Duplicate column names found: ['x']."), lambda d: d.select("x", "y", F.col("z").alias("x")), {}),
    (("warning", "The dataset contains 50 duplicate row(s)."), lambda d: d, {}),
    (("warning", "The dataset has fewer than 30 rows (7 rows)."), lambda d: d.limit(7), {}),
    (("warning", "Constant columns found: ['c', 'n']."), lambda d: d.withColumn("c", F.lit(1)).withColumn("n", F.lit(None).cast("string")), {}),
    (("error", "Infinite numeric values found in columns: ['i']."), lambda d: d.withColumn("i", F.when(F.col("z") == 1, float("-inf")).otherwise(1.0)), {}),
    (("error", "No target column selected."), lambda d: d, {"target": None}),
    (("error", "Target column 'w' is missing from the dataset."), lambda d: d, {"target": "w"}),
    (("error", "Column 'y' contains 200 empty values (50.0%). Please clean this column before training."),
     lambda d: d.withColumn("y", F.when(F.col("y") == "a", " n/A ").otherwise("b")), {}),
    (("error", "Classification target has only one class."), lambda d: d.withColumn("y", F.lit("a")), {}),
    (("warning", "Classification target has severe class imbalance."), lambda d: d.withColumn("y", (F.col("x") == 0).cast("int") * (F.col("z") == 1).cast("int")), {}),
    (("error", "Regression target 'y' is not numeric."), lambda d: d, {"task_type": "regression"}),
    (("error", "No feature columns selected."), lambda d: d, {"features": []}),
    (("error", "Selected feature columns are missing: ['q', 'r']."), lambda d: d, {"features": ["q", "x", "r"]}),
    (("error", "Column 'x' contains 8 empty values (2.0%). Please clean this column before training."),
     lambda d: d.withColumn("x", F.when(F.col("x") == 3, float("nan")).otherwise(F.col("x"))), {}),
    (("warning", "ID-like columns are selected as features: ['user_id']."), lambda d: d.withColumn("user_id", F.col("z")), {"features": ["user_id", "x"]}),
    (("warning", "ID-like columns are selected as features: ['z']."), lambda d: d, {"id_columns": ["z"]}),
    (("warning", "High-cardinality categorical features found: ['t']."), lambda d: d.withColumn("t", F.concat(F.lit("t"), F.col("x") * 10 + F.col("z"))), {"features": ["t"]}),
    (("warning", "Numeric-looking columns are stored as text: ['t']."), lambda d: d.withColumn("t", F.col("z").cast("string")), {"features": ["t", "x"]}),
    (("warning", "Categorical columns with rare levels found: ['t']."),
     lambda d: d.withColumn("t", F.when((F.col("x") == 0) & (F.col("z") == 1), "rare").otherwise("common")), {"features": ["t"]}),
    (("error", "Group split selected but the group column is missing."), lambda d: d, {"split_method": "group"}),
    (("error", "Time split selected but the date column is missing."), lambda d: d, {"split_method": "time", "date_column": "when"}),
    (("error", "Date column 'w' has 200 invalid date value(s)."),
     lambda d: d.withColumn("w", F.when(F.col("y") == "a", "2024-01-02").otherwise("soon")), {"split_method": "time", "date_column": "w"}),
    (("error", "Class 'c' has only 1 samples. It may not appear in all train/validation/test subsets."),
     lambda d: d.union(d.limit(1).withColumn("y", F.lit("c"))), {"split_method": "stratified"}),
    (("error", "SMOTE selected but the minority class has fewer than 2 samples."),
     lambda d: d.union(d.limit(1).withColumn("y", F.lit("c"))), {"imbalance_method": "smote"}),
    (("warning", "SMOTE selected while categorical features exist: ['t']."), lambda d: d.withColumn("t", F.lit("v")), {"features": ["x", "t"], "imbalance_method": "smote"}),
    (("warning", "SMOTE-NC selected but no categorical features exist."), lambda d: d, {"imbalance_method": "smote_nc"}),
    (("warning", "small is selected with more than 100 rows (400 rows)."), lambda d: d, {"selected_models": ["small", "large"], "row_capped_models": {"small": 100, "large": 1000}}),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0][1][:40])
def test_rule_holds(spark, clean, case):
    issue, change, settings = case
    base = {"target": "y", "features": ["x", "z"], "split_method": "random"}
    checks = tuple(c for c in G.ALL_CHECKS if c != "coverage")
    assert issue in messages(spark, change(clean), checks, **{**base, **settings})
    assert issue not in messages(spark, clean.dropDuplicates(), checks, **base)


def test_every_rule_has_a_case():
    stems = {r.message.split("{")[0].split("'")[0] for r in G.RULES}
    covered = {s for s in stems if any(m.startswith(s) for (_, m), _, _ in CASES)}
    assert stems - covered == {"The dataset has more than 5000 columns ("}  # too wide for a small test
    rule = next(r for r in G.RULES if "5000" in r.message)
    for width, hits in ((5000, 0), (5001, 1)):
        report = G.Report(None)
        G.evaluate([rule], {"dataset": [SimpleNamespace(width=width)]}, report)
        assert len(report.rows) == hits


def test_hashed_statistics_equal_plain_ones(spark):
    rows = [("1", 1.0, True), ("1", float("nan"), None), (" x", -0.0, False), (None, 0.0, False), ("2024-01-01", float("inf"), True)]
    df = spark.createDataFrame(rows * 3, "t string, d double, b boolean")
    got = {r["position"]: r.asDict() for r in P.column_statistics(df).collect()}
    keys = ("rows", "levels", "n_distinct", "non_missing", "gate_missing", "min_level", "numbers", "times", "infinite")
    assert [tuple(got[i][k] for k in keys) for i in range(3)] == [
        (15, 4, 3, 12, 3, 3, 6, 3, 0), (15, 4, 3, 12, 3, 3, 0, 0, 3), (15, 3, 2, 12, 3, 6, 0, 0, 0)
    ]
    assert tuple(P.duplicate_rows(df).first()) == (15, 10)
    swapped = spark.createDataFrame([("a", None), (None, "a")], "p string, q string")
    assert tuple(P.duplicate_rows(swapped).first()) == (2, 0)
