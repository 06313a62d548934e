"""Shared helpers of the corpus operators: tables, materialising, word shingles, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablier.session import scratch_path

#: Ids that may be broadcast: 2 M longs are 16 MB; beyond this the join shuffles.
BROADCAST_IDS = 2_000_000
#: Rows and bytes of an Arrow batch where the session keeps Spark's default of 10,000 rows: whole texts are long,
#: and so are the shingle sets of a pair; a batch ends at the bytes, so a run of long rows cannot fill a worker.
ARROW_ROWS = 1_000
ARROW_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A corpus table; its texts travel to Python in batches of at most ``ARROW_ROWS`` rows and about ``ARROW_BYTES``."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back (cuts lineage, survives executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def returning_memory(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """``run`` for mapInPandas; the worker then gives freed memory back to the system, as it lives on beside later stages."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc alone has it
            trim(0)

    return go


def sized_broadcast(ids: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint only when the counted rows stay under ``BROADCAST_IDS``."""
    return F.broadcast(ids) if n_rows <= BROADCAST_IDS else ids


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# ---------------------------------------------------------------- word shingles (numpy)

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    sep = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    pw, inv = _powers(len(raw) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((_LOWER[raw] + np.uint64(1)) * pw[: len(raw)], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * inv[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words: the whole sequence as one."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + w[i : i + n])
    return np.unique(h)


# ---------------------------------------------------------------- connected components


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every node of ``edges(a, b)``; comp is the smallest id reachable.

    Alternating large-star / small-star rounds: every round is two aggregates
    with a join back, so a hub with many neighbours is pre-aggregated before
    its shuffle and its join can be split. Each round is written out.
    """
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc"
    )
    state = _fingerprint(cur)
    while state[0]:
        sym = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low2, "hi")
            .select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
            .select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        nxt = materialize(small, "cc")
        new_state = _fingerprint(nxt)
        if new_state == state:
            break
        cur, state = nxt, new_state
    return cur.select(F.col("hi").alias("id"), F.col("lo").alias("comp")).union(
        cur.select(F.col("lo").alias("id"), F.col("lo").alias("comp")).distinct()
    )
