"""Bundles of asking leaves in k-NN."""

import numpy as np
from pyspark.sql import functions as F

from tablier.operators import knn as N


def test_leaves_ask_in_few_bundles(spark):
    """every leaf travelled to every asking leaf, so the bytes moved grew with the square of the rows."""
    leaves = spark.range(400).select(F.lit("g").alias("_g"), F.lpad(F.col("id").cast("string"), 4, "0").alias("_leaf"), (F.col("id") % 4 * 500).alias("_asked"))
    bundles, number = N.bundled(leaves)
    rows = bundles.orderBy("_asker").collect()
    assert len(rows) == 300 and number == N.BUNDLES
    assert len({r["_bundle"] for r in rows}) <= N.BUNDLES
    assert [r["_bundle"] for r in rows] == sorted(r["_bundle"] for r in rows)


def test_bundled_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_TARGET", 60)
    monkeypatch.setattr(N, "BUNDLE_LEAST", 50)
    x = np.random.default_rng(3).normal(size=(700, 8))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>")
    found = N.knn_within_groups(df, "id", None, "x", 3, 42, query=F.col("id") % 5 == 0, member=F.col("id") % 5 != 0).collect()
    got = {(int(r["key"]), r["nn_rank"]): int(r["nn_key"]) for r in found}
    members = np.array([i for i in range(700) if i % 5])
    for q in range(0, 700, 5):
        order = members[np.argsort(((x[members] - x[q]) ** 2).sum(1), kind="stable")][:3]
        assert [got[q, i] for i in (1, 2, 3)] == order.tolist()
