"""Rows of a fit over all cores, whatever files they come from; row-sized joins without a broadcast."""

from pyspark.sql import functions as F

from tablier.operators import estimators as K
from tablier.operators import imbalance as H
from tablier.operators import ranking as R
from tablier.operators.running import BYTES_PER_TASK, ROWS_PER_TASK, spread


def one_file(spark, rows):
    return K.assemble(spark.range(0, rows, 1, 1).withColumn("x", (F.col("id") % 7).cast("double")), ["x"]).withColumn("label", F.col("x") * 2)


def test_ranks_and_draws_broadcast_no_rows(spark):
    """rows that are small as files were sent to the driver, in every fold."""
    df = spark.range(1000).select("id", F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("c"))
    ranked = R.exact_rank(df, F.md5(F.col("id").cast("string")), ["c"])
    drawn = H.oversample(df, "id", "c", {"b": 800}, 42)
    for made, rows in ((ranked, 1000), (drawn, 1600)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == rows
    assert sorted(r[0] for r in ranked.where("c = 'b'").select("_rank").collect()) == list(range(1, 201))


def test_fit_deals_rows_of_one_file_out(spark):
    """one task held all rows, with a count for each of 200 trees."""
    rows = 3 * ROWS_PER_TASK
    dealt = K._dealt_out(one_file(spark, rows), K.configured("random_forest_regressor"), "features")
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == rows
    assert max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) * 900 < BYTES_PER_TASK
    few = one_file(spark, ROWS_PER_TASK)
    assert spread(few, ROWS_PER_TASK, 1000) is few
    assert spread(few, 10 * ROWS_PER_TASK, BYTES_PER_TASK // ROWS_PER_TASK).rdd.getNumPartitions() == 10
    fitted = K.fit_model("linear_regression", one_file(spark, rows))
    assert abs(float(fitted.model.coefficients[0]) - 2) < 1e-9


def test_saved_split_is_made_once(spark, tmp_path):
    """Every table beside the saved split computed the whole split anew."""
    from tablier.operators import artifacts as A

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x)

    parts = spark.range(90).select(
        counted("id").alias("x"), (F.col("id") % 2).cast("string").alias("label"),
        F.when(F.col("id") < 60, "train").when(F.col("id") < 75, "validation").otherwise("test").alias("split"), F.lit(False).alias("synthetic"),
    )
    full = spark.range(90).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    A.save_split(spark, full, parts, str(tmp_path / "out"), ["x"], "y", {}, {})
    assert made.value == 90
    assert spark.read.parquet(str(tmp_path / "out" / "class_coverage")).agg(F.sum("full_count")).first()[0] == 90
