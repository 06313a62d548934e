"""Operator 4: approximate nearest neighbours by a hash-prefix forest (cosine).

Vectors are dealt to shards of bounded size by a hash of their values, so copies
and clusters cannot pile up. Every shard holds ``TREES`` sorted arrays of
``BITS``-bit sign hashes of random projections. A query descends in every tree
to its longest matching prefix (a binary search per length) and all trees then
ascend together, one bit at a time, until the matches of all trees count at
least ``m``. Their union is scored exactly in double precision, and the best of
all shards are merged. ``m`` is a share of the shard, the smallest of ``SHARES``
whose recall against brute force is at least ``RECALL`` on up to ``PROBES``
queries; the share 1 is brute force, so the target is always met.

Equal vectors are searched once and keep their k+1 smallest ids, found by
windows that Spark prunes before the shuffle. Vectors that are null, zero or
hold null or non-finite values take no part; only vectors of equal length are
compared. Fewer than k candidates: all of them. Repeated vec_ids count once per
distinct vector. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, BITS = 16, 32
#: Vectors of a shard, queries of a block: what one task holds.
SHARD_ROWS, QUERY_ROWS = 8_192, 8_192
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
RECALL, PROBES = 0.97, 64


def _valid(df: DataFrame, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.withColumn("v", v).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(ok)


def _hashes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    bits = (x @ planes > 0).reshape(len(x), TREES, BITS)
    return (bits * (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).T


class Forest:
    """Sorted hash arrays of one shard."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt(np.einsum("ij,ij->i", x, x))
        self.planes = np.random.default_rng(4).normal(size=(x.shape[1], TREES * BITS))
        h = _hashes(x, self.planes)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, 1)

    def ranges(self, q: np.ndarray):
        """First and last position in every tree that shares the first ``length`` bits with each query."""
        h = _hashes(q, self.planes)
        lo = np.empty((BITS + 1, TREES, len(q)), np.int64)
        hi = np.empty_like(lo)
        for length in range(BITS + 1):
            low = (h >> np.uint64(BITS - length)) << np.uint64(BITS - length)
            high = low + (np.uint64(1) << np.uint64(BITS - length))
            for t in range(TREES):
                lo[length, t] = np.searchsorted(self.sorted[t], low[t])
                hi[length, t] = np.searchsorted(self.sorted[t], high[t])
        return lo, hi

    def search(self, q: np.ndarray, shares, top: int):
        """For every query and share: positions and scores of the ``top`` best candidates."""
        lo, hi = self.ranges(q)
        found = (hi - lo).sum(axis=1)
        qn = np.sqrt(np.einsum("ij,ij->i", q, q))
        for i in range(len(q)):
            for share in shares:
                need = max(top, int(np.ceil(share * len(self.x))))
                if share >= 1:
                    c = np.arange(len(self.x))
                else:
                    # the deepest level at which all trees together give ``need`` different candidates
                    level = int(np.flatnonzero(found[:, i] >= min(need, found[0, i]))[-1])
                    while True:
                        c = np.unique(np.concatenate([self.order[t, lo[level, t, i] : hi[level, t, i]] for t in range(TREES)]))
                        if len(c) >= min(need, len(self.x)) or not level:
                            break
                        level -= 1
                s = (self.x[c] * q[i]).sum(axis=1) / (self.norm[c] * qn[i])
                if len(c) > top:
                    cut = np.partition(s, len(s) - top)[len(s) - top]
                    c, s = c[s >= cut], s[s >= cut]
                yield i, share, c, s


def _searcher(shares: tuple, k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            forest = Forest(np.stack(rows["v"].to_numpy()).astype(float))
            ids = rows["ids"].to_numpy()
            qid = queries["query_id"].to_numpy()
            # a query may meet itself, so one place more than k
            for i, share, c, s in forest.search(np.stack(queries["v"].to_numpy()).astype(float), shares, k + 1):
                best = sorted((-x, int(v)) for x, j in zip(s.tolist(), c.tolist()) for v in ids[j] if v != qid[i])[:k]
                out += [(int(qid[i]), share, v, -x) for x, v in best]
        return pd.DataFrame(out, columns=["query_id", "share", "vec_id", "score"])

    return run


def _found(vectors: DataFrame, queries: DataFrame, shares: tuple, k: int) -> DataFrame:
    """(query_id, share, vec_id, score, rank) over all shards."""
    pairs = vectors.groupBy("dim", "shard", "block").cogroup(queries.groupBy("dim", "shard", "block"))
    hits = pairs.applyInPandas(_searcher(shares, k), "query_id long, share double, vec_id long, score double")
    w = Window.partitionBy("query_id", "share").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row whose id is divisible by ``every``."""
    rows = _valid(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding").where("vec_id IS NOT NULL")
    rows = rows.select("vec_id", "v").dropDuplicates()
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    distinct = materialize(
        kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "ann-vectors"
    )
    queries = materialize(
        rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim")), "ann-queries"
    )
    shards = distinct.count() // SHARD_ROWS + 1
    blocks = queries.count() // QUERY_ROWS + 1

    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")

    def dealt(q: DataFrame, n_blocks: int) -> tuple[DataFrame, DataFrame]:
        v = distinct.select("dim", "v", "ids", shard, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        at = block if n_blocks > 1 else F.lit(0).alias("block")
        return v, q.select("dim", "query_id", "v", at, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    probes = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBES)
    tried = materialize(_found(*dealt(probes, 1), SHARES, k), "ann-probes")
    truth = tried.where("share = 1").select("query_id", "vec_id")
    recall = {
        r.share: r.n
        for r in tried.join(truth, ["query_id", "vec_id"]).groupBy("share").agg(F.count("*").alias("n")).collect()
    }
    share = next((s for s in SHARES if recall.get(s, 0) >= RECALL * recall.get(1.0, 0)), 1.0)
    return _found(*dealt(queries, blocks), (share,), k).select("query_id", "rank", "vec_id", "score")
