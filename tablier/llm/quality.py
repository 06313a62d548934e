"""Operator 6: quality scores from random Fourier features of document statistics.

Every text becomes ``len(NAMES)`` statistics. Standardised, they pass through
``COSINES`` random Fourier features of a Gaussian kernel. Each partition sums
its share of the normal equations, the sums are added, and the driver solves
one ridge system of fixed size. The raw scores of a training part that the
ridge has not seen are binned and calibrated by isotonic regression.

Training rows have crc32(doc_id) % 5 of 1, 2, 3 (ridge) and 4 (calibration);
all of them are used. Null and empty texts have all-zero statistics and a score
like any other. Without training labels every score is 0.5; if the calibration
part has no labels, raw scores are clipped to 0..1. Repeated rows are kept.
Rows with a null label or doc_id teach nothing; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .toxicity import held_out

COSINES = 256
RIDGE = 1e-3
#: Partial sums are added in this many tasks before they reach the driver.
ADDERS = 8
NAMES = (
    "log_bytes log_words word_len upper digit space newline ascii_punct symbols pipes bangs quotes dots non_ascii "
    "caps_words symbol_words pipe_words bang_words distinct_words line_words distinct_lines short_lines longest_word log_lines"
).split()

_BYTE = np.arange(256)
_UP = (_BYTE >= 65) & (_BYTE <= 90)
_LOW = (_BYTE >= 97) & (_BYTE <= 122)
_SYMBOL = np.isin(_BYTE, [ord(c) for c in "#$%&*+=<>^~\\@{}[]_`"])


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    c = np.bincount(raw, minlength=256)
    words = text.split()
    k = max(len(words), 1)
    lines = text.split("\n")
    letters = max(int(c[_UP].sum() + c[_LOW].sum()), 1)
    caps = sum(1 for w in words if w.isupper())
    symbol = sum(1 for w in words if w[-1] in "#$%&*+=<>^~\\@{}[]_`")
    bang = sum(1 for w in words if w[-1] == "!")
    return [
        np.log1p(n),
        np.log1p(len(words)),
        n / k,
        c[_UP].sum() / letters,
        c[48:58].sum() / n,
        c[32] / n,
        c[10] / n,
        c[33:48].sum() / n,
        c[_SYMBOL].sum() / n,
        c[124] / n,
        c[33] / n,
        (c[34] + c[39]) / n,
        c[46] / n,
        c[128:].sum() / n,
        caps / k,
        symbol / k,
        sum(1 for w in words if w == "|") / k,
        bang / k,
        len(set(words)) / k,
        np.log1p(k / len(lines)),
        len(set(lines)) / len(lines),
        sum(1 for x in lines if len(x) < 30) / len(lines),
        np.log1p(max(map(len, words), default=0)),
        np.log1p(len(lines)),
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})


@dataclass
class Fourier:
    """Standardisation and the random projection, fixed by a seed."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d = len(self.mean)
        rng = np.random.default_rng(6)
        w = rng.normal(0, 1 / np.sqrt(d), (d, COSINES))
        b = rng.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def _sums(fourier: Fourier):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, n = np.zeros((COSINES + 1, COSINES + 2)), 0
        for pdf in batches:
            if len(pdf):
                z = fourier(np.stack(pdf["x"].to_numpy()))
                a += z.T @ np.hstack([z, pdf[["y"]].to_numpy(float)])
                n += len(pdf)
        if n:
            yield pd.DataFrame({"a": [a.tobytes()], "n": [n]})

    return run


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = 0.0, 0
    for pdf in batches:
        for b, k in zip(pdf["a"], pdf["n"]):
            total, n = total + np.frombuffer(b), n + int(k)
    if n:
        yield pd.DataFrame({"a": [total.tobytes()], "n": [n]})


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], weight[order]):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclass
class QualityModel:
    fourier: Fourier
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def scores(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return np.clip(np.interp(r, self.knots, self.values) if len(self.knots) else r, 0, 1)


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Model from (doc_id, x) of all documents and the labels of the training rows."""
    d = len(NAMES)
    moments = stats.agg(
        F.count("*"), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    ).first()
    mean = np.array([moments[1 + 2 * i] or 0.0 for i in range(d)])
    scale = np.array([moments[2 + 2 * i] or 1.0 for i in range(d)])
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(
        "doc_id IS NOT NULL AND y IS NOT NULL"
    ).where(~held_out())
    train = stats.join(y, "doc_id").withColumn("part", F.expr("crc32(cast(doc_id AS string)) % 5"))
    partial = train.where("part <> 4").select("x", "y").mapInPandas(_sums(fourier), "a binary, n long")
    sums = partial.repartition(ADDERS).mapInPandas(_add, "a binary, n long").collect()
    if not sums:
        return QualityModel(fourier, np.append(np.zeros(COSINES), 0.5), np.empty(0), np.empty(0))
    a = sum(np.frombuffer(r.a).reshape(COSINES + 1, COSINES + 2) for r in sums)
    n = sum(r.n for r in sums)
    ridge = RIDGE * n * np.eye(COSINES + 1) / COSINES
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(a[:, :-1] + ridge, a[:, -1])
    model = QualityModel(fourier, beta, np.empty(0), np.empty(0))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r = np.clip(model.raw(np.stack(pdf["x"].to_numpy())), -1, 2)
                yield pd.DataFrame({"bin": np.round(r * 500).astype(np.int64), "y": pdf["y"].to_numpy(float)})

    bins = (
        train.where("part = 4").select("x", "y").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    ).collect()
    if bins:
        model.knots, model.values = isotonic(
            np.array([b.bin / 500 for b in bins]), np.array([b.y for b in bins]), np.array([b.n for b in bins], float)
        )
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    stats = materialize(texts.mapInPandas(_measure, "doc_id long, x array<double>"), "quality-stats")
    model = fit(stats, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.empty((0, len(NAMES)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.scores(x)})

    return stats.mapInPandas(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
