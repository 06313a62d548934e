"""Cuts over any rows: null and repeated keys, equal rows, strata by the hundred thousand."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablier.functions.hashing import row_digest
from tablier.operators import imbalance as H
from tablier.operators import preprocess as P
from tablier.operators import ranking as R
from tablier.operators import split as S


def parts(df, col="split"):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def loose(spark):
    """Null keys, repeated keys and many equal rows."""
    return spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), (F.col("id") % 4).alias("y"), (F.col("id") % 2).cast("string").alias("s")
    )


def test_counts_are_exact_with_null_and_repeated_keys(spark):
    keys = spark.range(100).select(F.when(F.col("id") >= 10, F.col("id")).alias("k"))
    assert parts(S.split(keys, "k", "random", 0.2, 42)) == {"train": 80, "test": 20}
    tens = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert parts(S.split(tens, "k", "random", 0.25, 42)) == {"train": 75, "test": 25}
    same = spark.range(3000).select(F.lit(1).alias("k"), F.lit("x").alias("t"))
    assert parts(S.split_three_way(same, "k", "random", 70, 10, 20, 42)) == {"train": 2100, "validation": 300, "test": 600}


def test_group_without_name_takes_one_place(spark):
    df = spark.range(100).select("id", F.when(F.col("id") >= 20, F.col("id") % 12).alias("g"))
    out = S.split(df, "id", "group", 0.2, 42, group="g")
    held = {r.g for r in out.where("split = 'test'").select("g").distinct().collect()}
    assert len(held) == 3 and out.count() == 100  # ceil(0.2 * 13)
    assert out.where("g IS NULL").select("split").distinct().count() == 1


@pytest.mark.parametrize("method", ["random", "stratified", "time"])
def test_any_rows_split_alike_on_any_partitioning(spark, method):
    df = loose(spark).withColumn("d", F.when(F.col("y") > 1, F.lit("2024-01-02")).otherwise("2024-01-01"))
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = S.split_three_way(df.repartition(int(n)), "k", method, 70, 10, 20, 42, target="y", date="d")
            seen.append(Counter(tuple(r) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert seen[0] == seen[1] and sum(seen[0].values()) == 1000
    assert Counter(k[:-1] for k in seen[0].elements()) == Counter(tuple(r) for r in df.collect())
    got = Counter(k[-1] for k in seen[0].elements())
    assert got == {"train": 700, "validation": 100, "test": 200}


def test_stratified_quotas_hold_on_equal_rows(spark):
    out = S.split(loose(spark), "k", "stratified", 0.2, 42, target="y")
    got = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert got == {(y, p): n for y in range(4) for p, n in (("train", 200), ("test", 50))}


def test_levels_small_tasks_and_written_strata_change_nothing(spark, monkeypatch):
    df = loose(spark).withColumn("d", F.lit("2024-01-01"))

    def run():
        return [
            Counter(tuple(r) for r in S.split(df, "k", m, 0.3, 5, target="y", date="d").collect()) for m in ("random", "stratified", "time")
        ]

    base = run()
    monkeypatch.setattr(R, "EXACT_MAX_ROWS", 5)
    monkeypatch.setattr(R, "LOCAL_ROWS", 2)
    monkeypatch.setattr(R, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(R, "COPIES_PER_TASK", 3)
    assert run() == base


def test_largest_remainder_of_a_table_equals_the_dict(spark, monkeypatch):
    df = spark.range(997).select("id", (F.col("id") % 13 * (F.col("id") % 3)).cast("string").alias("y"))
    s = R.Strata.of(df, R.stratum_col("y"))
    want = {r["_g"]: r["_q"] for r in R.remainder_quotas(s, 333).collect()}
    monkeypatch.setattr(R, "LOCAL_ROWS", 2)
    s = R.Strata.of(df, R.stratum_col("y"))
    assert s.rows is None
    assert {r["_g"]: r["_q"] for r in R.remainder_quotas(s, 333).collect()} == want
    assert sum(s.n for s in [s]) - sum(want.values()) == 333


def test_more_than_200000_classes(spark):
    df = spark.range(660_000).select("id", (F.col("id") % 220_000).alias("y"))
    out = S.split(df, "id", "stratified", 1 / 3, 42, target="y")
    per = out.groupBy("y").pivot("split", ["train", "test"]).count()
    assert per.where("train = 2 AND test = 1").count() == 220_000
    assert H.undersample(df.where("id < 659999"), "id", "y").count() == 220_000 * 2


def test_row_cap_is_exact_on_repeated_keys(spark):
    from tablier.operators.estimators import row_cap

    assert row_cap(loose(spark), "k", 123).count() == 123


def test_row_digest_tells_rows_apart(spark):
    rows = [("a", "bc", None, b"x", [1, 2]), ("ab", "c", None, b"x", [1, 2]), ("a", "bc", 0.0, b"x", [1, 2]), ("a", "bc", None, b"y", [1, 2]), ("a", "bc", None, b"x", [12])]
    df = spark.createDataFrame(rows, "a string, b string, c double, d binary, e array<int>")
    assert df.select(row_digest(df, df.columns).alias("h")).distinct().count() == len(rows)


def test_empty_tables(spark):
    empty = loose(spark).where("false")
    with pytest.raises(ValueError, match="empty"):
        S.split(empty, "k", "random", 0.2)
    assert H.undersample(empty, "k", "y", {}).count() == 0


def test_medians_of_many_columns_take_as_many_jobs_as_of_one(spark, monkeypatch):
    import numpy as np

    import tablier.operators.quantile as Q

    rng = np.random.default_rng(3)
    n = 4001
    data = {
        "normal": rng.normal(size=n), "decades": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), "flag": rng.integers(0, 2, n) * 1.0,
        "heavy": np.where(rng.random(n) < 0.7, 7.0, rng.normal(size=n)), "ends": np.where(rng.random(n) < 0.3, np.inf, rng.normal(size=n)),
        "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), "one": np.full(n, 3.5), "none": np.full(n, np.nan),
        "two": np.where(np.arange(n) < 2, np.arange(n) * 1.0, np.nan), "low": np.where(rng.random(n) < 0.3, -np.inf, rng.normal(size=n)),
    }
    df = spark.createDataFrame(list(zip(*(map(float, v) for v in data.values()))), ", ".join(f"{c} double" for c in data)).cache()
    want = {c: (None if np.isnan(v).all() else float(np.nanmedian(v))) for c, v in data.items()}
    tracker = spark.sparkContext.statusTracker()
    for exact in (200_000, 50, 1):
        monkeypatch.setattr(Q, "EXACT_ROWS", exact)
        assert Q.exact_medians(df, list(data)) == pytest.approx(want)
    monkeypatch.setattr(Q, "EXACT_ROWS", 50)
    jobs = []
    for i, columns in enumerate((["normal"], [f"n{j}" for j in range(30)])):
        wide = df.select(*[F.col("normal").alias(c) for c in columns])
        spark.sparkContext.setJobGroup(f"medians-{i}", "count jobs")
        Q.exact_medians(wide, columns)
        jobs.append(len(tracker.getJobIdsForGroup(f"medians-{i}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    assert Q.order_statistics(df, "normal", [1, 17, n]) == {k: np.sort(data["normal"])[k - 1] for k in (1, 17, n)}
    assert Q.most_frequent_values(df, ["flag", "heavy", "none"]) == {"flag": float(np.bincount(data["flag"].astype(int)).argmax()), "heavy": 7.0, "none": None}


def test_gram_matrix_of_500_columns_is_one_job(spark):
    import numpy as np

    from tablier.operators.stats import gram_matrix

    x = np.random.default_rng(1).normal(size=(40, 500))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(500)]).repartition(5)
    spark.sparkContext.setJobGroup("gram", "count jobs")
    got = gram_matrix(df, df.columns)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("gram")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(got, x.T @ x) and len(jobs) <= 3  # the shuffle stages of one query
    gaps = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert gram_matrix(gaps, ["a", "b"], intercept=True).tolist() == [[2.0, 3.0, 3.0], [3.0, 5.0, 6.0], [3.0, 6.0, 9.0]]


def test_sparse_levels_are_not_named_in_the_column(spark):
    """one attribute per level on the driver made one_hot_many fail with millions of levels."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("c"))
    levels = P.level_table(df.where("id < 2000"), F.coalesce("c", F.lit("Unknown")))
    out = P.encode_sparse(df, "c", levels, "hot")
    assert out.schema["hot"].metadata == {} and out.columns == ["id", "c", "hot"]
    names = [r[0] for r in levels.orderBy("index").collect()]
    for r in out.collect():
        level = r.c or "Unknown"
        assert r.hot.size == len(names) and r.hot.indices.tolist() == ([names.index(level)] if level in names else [])
        assert r.hot.values.tolist() == [1.0] * len(r.hot.indices)


def test_many_strata_are_ranked_in_one_shuffle(spark, monkeypatch):
    """rows of many small strata travelled with their sort keys for every step of the search of cuts."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("k"), (F.col("id") % 61).alias("g"), (F.col("id") % 3).alias("x"), (F.col("id") % 5 > 0).alias("w")
    )
    key = F.md5(F.col("k").cast("string"))

    def marked():
        by_cuts = R.mark_first(df, key, "g", lambda s: s.df.withColumn("_q", F.col("_n") - 20), "first", F.col("w"))
        return Counter(tuple(r) for r in by_cuts.collect()), Counter(tuple(r) for r in H.undersample(df, "k", "g").collect())

    few = marked()
    monkeypatch.setattr(R, "LOCAL_ROWS", 10)
    assert marked() == few
    monkeypatch.setattr(R, "find_cuts", None)
    assert marked() == few
