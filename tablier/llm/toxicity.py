"""Operator 8: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives P, every document is unlabelled text U.
Features are hashed words and word beginnings (4, 5, 6 bytes), as presence.

1. Every hash value that ``MIN_POSITIVES`` rows of P hold is counted over all
   documents (the hash space of ``BUCKET_BITS`` bits bounds their number), and
   at most ``FEATURES`` with the largest surplus in P (in standard errors) are
   kept.
2. A numpy logistic model minimises the class-prior-corrected risk
   pi*R_P(+1) + max(0, R_U(-1) - pi*R_P(-1)); where the second part is negative
   the gradient steps back, which keeps the estimator non-negative. It is
   fitted on bounded samples (``SAMPLE_P``, ``SAMPLE_U`` rows in the order of a
   hash of doc_id). The prior pi is the toxic share of the training labels.
   A bounded sample of labelled training rows (``SAMPLE_L``) then shifts the
   margin so that 0.5 is the cut with their best F1.
3. Every whole text is scored in one pass; only the feature list and weights
   travel to the tasks.

Null and empty texts get the score of a text without features. No training
positives: the score is the prior for every row. Repeated rows are kept. Labels
that contradict one another count as toxic, repeated ones once. Rows with a null
label or doc_id teach nothing; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _powers, mix64, returning_memory, sized_broadcast, text_or_empty

BUCKET_BITS = 22
FEATURES = 1024
#: A feature needs this many positives, and this surplus in standard errors over its share of all documents.
MIN_POSITIVES, MIN_SURPLUS = 4, 4.0
#: ... and this estimated share of toxic texts among the documents that hold it.
MIN_SHARE = 0.5
#: Bounds of the fitting sample, in rows.
SAMPLE_P, SAMPLE_U, SAMPLE_L = 4_000, 8_000, 8_000
PREFIXES = (4, 5, 6)

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(text: str | None) -> np.ndarray:
    """Hash values of the words of the text and of their beginnings (with repeats)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    sep = np.concatenate(([True], _BREAK[raw], [True]))
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64)
    pw, inv = _powers(len(raw) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((_LOWER[raw] + np.uint64(1)) * pw[: len(raw)], dtype=np.uint64)))
    size = ends - starts
    parts = [mix64((total[ends] - total[starts]) * inv[starts])]
    for p in PREFIXES:
        at = starts[size > p]
        parts.append(mix64((total[at + p] - total[at]) * inv[at] + np.uint64(p)))
    return (np.concatenate(parts) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def lookup(self) -> np.ndarray:
        return _lookup(self.buckets)

    def scores(self, texts, table: np.ndarray) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            z[i] += self.weights[_present(t, table)].sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lookup(buckets: np.ndarray) -> np.ndarray:
    table = np.full(1 << BUCKET_BITS, -1, np.int32)
    table[buckets] = np.arange(len(buckets), dtype=np.int32)
    return table


def _present(text: str | None, table: np.ndarray) -> np.ndarray:
    at = table[features(text)]
    return np.unique(at[at >= 0])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.expr(f"crc32(cast({doc_id} AS string)) % 5 = 0")


def _count_held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << BUCKET_BITS, np.int32)
    for pdf in batches:
        for t in pdf["text"]:
            counts[np.unique(features(t))] += 1
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": at, "n": counts[at].astype(np.int64)})


def _count_chosen(buckets):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, counts = _lookup(buckets.value), np.zeros(len(buckets.value), np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                counts[_present(t, table)] += 1
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": buckets.value[at], "n": counts[at]})

    return run


def _rows(buckets: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _lookup(buckets)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "at": [_present(t, table) for t in pdf["text"]]})

    return run


def _matrix(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        x[i, list(r.at)] = 1
    return x


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 600, batch: int = 1000, rate: float = 0.02, l2: float = 1e-4):
    """Weights and bias of the logistic model with the smallest non-negative PU risk (Adam on mini-batches)."""
    rng = np.random.default_rng(8)
    d = xp.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        p = xp[rng.integers(0, len(xp), min(batch, len(xp)))]
        u = xu[rng.integers(0, len(xu), min(2 * batch, len(xu)))]
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(p), np.zeros(len(u))
        if negative >= 0:
            gp, gu = gp - prior * sp / len(p), su / len(u)
        else:
            # the corrected risk of the negatives fell below zero: step back along it
            gp, gu = prior * sp / len(p), -su / len(u)
        g = np.append(gp @ p + gu @ u + l2 * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The margin with the best F1 on labelled training rows, halfway between neighbouring values."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    if not y.sum():
        return 0.0
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # equal margins stay together
    i = int(np.argmax(f1))
    return float((z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 1)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Model of the rows whose crc32(doc_id) % 5 is not 0; see the module's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IS NOT NULL"
    ).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_all, n_pos = train.agg(F.count("*"), F.sum("toxic")).first()
    if not n_pos:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), float(np.log(1e-3)), 1e-3)
    prior = min(max(n_pos / n_all, 1e-3), 0.999)
    positives = docs.join(sized_broadcast(train.where("toxic = 1").select("doc_id").distinct(), n_pos), "doc_id", "left_semi")

    def counted(rows: DataFrame, count) -> DataFrame:
        return rows.mapInPandas(returning_memory(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    # at most 2^BUCKET_BITS pairs of numbers
    in_p = counted(positives, _count_held).where(F.col("n") >= MIN_POSITIVES).orderBy("bucket").toPandas()
    if in_p.empty:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))), prior)
    buckets, np_ = in_p["bucket"].to_numpy(np.int64), in_p["n"].to_numpy(np.int64)
    in_u = counted(docs, _count_chosen(docs.sparkSession.sparkContext.broadcast(buckets))).toPandas()
    nu = np.zeros(len(buckets), np.int64)
    nu[np.searchsorted(buckets, in_u["bucket"].to_numpy(np.int64))] = in_u["n"].to_numpy(np.int64)
    n_docs = docs.count()
    ru = (np.maximum(nu, np_) + 0.5) / (n_docs + 1)
    expected = ru * n_pos
    surplus = (np_ - expected) / np.sqrt(expected + 1)
    surplus[prior * np_ / n_pos < MIN_SHARE * ru] = 0
    top = np.argsort(-surplus, kind="stable")[:FEATURES]
    buckets = np.sort(buckets[top[surplus[top] >= MIN_SURPLUS]])
    if not len(buckets):
        return ToxicityModel(buckets, np.empty(0), float(np.log(prior / (1 - prior))), prior)

    def sample(df: DataFrame, n: int) -> list:
        picked = df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        rows = df.join(F.broadcast(picked), "doc_id", "left_semi").mapInPandas(returning_memory(_rows(buckets)), "doc_id long, at array<int>")
        return rows.limit(n).collect()

    d = len(buckets)
    w, b = fit_nnpu(_matrix(sample(positives, SAMPLE_P), d), _matrix(sample(docs, SAMPLE_U), d), prior)
    known = sample(docs.join(sized_broadcast(train.select("doc_id").distinct(), n_all), "doc_id", "left_semi"), SAMPLE_L)
    truth = {
        r.doc_id: r.toxic
        for r in train.join(F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in known], "doc_id long")), "doc_id", "left_semi").collect()
    }
    z = _matrix(known, d) @ w + b
    return ToxicityModel(buckets, w, b - best_cut(z, np.array([truth[r.doc_id] for r in known])), prior)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with ``score`` in 0..1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.lookup()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.scores(pdf["text"].tolist(), table)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(
        run, "doc_id long, score double"
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""
    model = fit(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.lookup()
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column("text").to_pylist(), table) < threshold))

    return docs.mapInArrow(returning_memory(run), docs.schema).select(*names)
