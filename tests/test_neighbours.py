"""Neighbours against brute force: trees of several levels, copies, few members, nominal values."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablier.operators import knn as K


def brute(rows, k, penalty=None):
    """rows: (key, group, vector, nominal, asks, answers)."""
    out = {}
    for key, g, v, cat, asks, _ in rows:
        if asks:
            d = []
            for other, og, ov, ocat, _, answers in rows:
                if answers and og == g and str(other) != str(key):
                    apart = ((np.array(v) - np.array(ov)) ** 2).sum() + (penalty or {}).get(g, 0.0) * sum(a != b for a, b in zip(cat, ocat))
                    d.append((round(float(np.sqrt(apart)), 9), str(other)))
            out[str(key)] = sorted(d)[:k]
    return out


def got(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["key"], []).append((r["nn_rank"], round(r["distance"], 9), r["nn_key"]))
    return {q: [(d, n) for _, d, n in sorted(v)] for q, v in out.items()}


def table(spark, rows):
    return spark.createDataFrame(
        [(key, g, [float(x) for x in v], *cat, bool(a), bool(m)) for key, g, v, cat, a, m in rows],
        "key long, g string, v array<double>, n1 string, n2 string, asks boolean, answers boolean",
    )


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(K, "CELL_TARGET", 12)
    monkeypatch.setattr(K, "PIVOTS", 4)
    monkeypatch.setattr(K, "ROWS_PER_TASK", 25)
    monkeypatch.setattr(K, "PACKET_BYTES", 40)


def clusters(n, seed, dims=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=50, size=(9, dims))
    return [centres[rng.integers(9)] + rng.normal(size=dims) for _ in range(n)]


def test_tree_of_several_levels_with_copies(spark, small_leaves, caplog):
    vectors = clusters(400, 1)
    vectors[50:170] = [vectors[50]] * 120  # one vector a third of the rows
    rows = [(i, "ab"[i % 3 == 0], v, ("x", "y"), True, True) for i, v in enumerate(vectors)]
    with caplog.at_level(logging.INFO, logger=K.__name__):
        assert got(K.knn_within_groups(table(spark, rows), "key", "g", "v", 4)) == brute(rows, 4)
    leaves, compared, of = (int(x) for x in __import__("re").findall(r"\d+", caplog.messages[-1])[:3])
    assert leaves > 30 and compared < 0.5 * of


def test_queries_and_members_apart_and_few_members(spark, small_leaves):
    rows = [(i, "a", v, ("", ""), i % 4 > 0, i % 4 == 0 and i < 80) for i, v in enumerate(clusters(200, 2, 2))]
    frame = table(spark, rows)
    found = K.knn_within_groups(frame, "key", None, "v", 3, query=F.col("asks"), member=F.col("answers"))
    rows = [(k, "", *rest) for k, _, *rest in rows]
    assert got(found) == brute(rows, 3)
    # fewer members than neighbours wanted
    found = K.knn_within_groups(frame, "key", None, "v", 30, query=F.col("asks"), member=F.col("answers"))
    assert got(found) == brute(rows, 30)


def test_nominal_values_count(spark, small_leaves):
    rng = np.random.default_rng(5)
    rows = [(i, "a", v, (str(rng.integers(3)), str(rng.integers(2))), True, True) for i, v in enumerate(clusters(150, 3))]
    penalty = {"a": 7.5}
    found = K.knn_within_groups(table(spark, rows), "key", "g", "v", 5, nominal=["n1", "n2"], nominal_penalty=penalty)
    assert got(found) == brute(rows, 5, penalty)


def test_vectors_with_gaps_take_no_part(spark):
    df = spark.createDataFrame(
        [(1, [0.0, 1.0]), (2, [0.0, -0.0]), (3, [-0.0, 0.0]), (4, [float("nan"), 0.0]), (5, [None, 0.0]), (6, None)], "key long, v array<double>"
    )
    assert got(K.knn_within_groups(df, "key", None, "v", 2)) == {"1": [(1.0, "2"), (1.0, "3")], "2": [(0.0, "3"), (1.0, "1")], "3": [(0.0, "2"), (1.0, "1")]}
    assert K.knn_within_groups(df.where("key = 1"), "key", None, "v", 2).count() == 0
    assert K.knn_within_groups(df.where("false"), "key", None, "v", 2).count() == 0


def test_all_rows_equal(spark, small_leaves):
    df = spark.range(500).select(F.col("id").alias("key"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    out = got(K.knn_within_groups(df, "key", None, "v", 3))
    smallest = sorted(map(str, range(500)))
    assert out == {k: [(0.0, x) for x in smallest if x != k][:3] for k in smallest}
