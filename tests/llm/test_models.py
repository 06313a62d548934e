"""The fitted models of operators 6 and 8 against plain computations over all rows."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablier.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def in_training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_quality_model_equals_plain_ridge(spark):
    docs, labels = tables(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    stats = docs.select("doc_id", "text").mapInPandas(quality._measure, "doc_id long, x array<double>")
    model = quality.fit(stats, labels)
    x = np.array([quality.statistics(t) for t in texts.values()])
    assert np.allclose(model.fourier.mean, x.mean(0)) and np.allclose(model.fourier.scale, np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    rows = [(texts[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 not in (0, 4)]
    z = model.fourier(np.array([quality.statistics(t) for t, _ in rows]))
    y = np.array([q for _, q in rows], float)
    ridge = quality.RIDGE * len(y) * np.eye(z.shape[1]) / quality.COSINES
    ridge[-1, -1] = 1e-9
    assert np.allclose(z @ model.beta, z @ np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-6)
    # the random features approximate the Gaussian kernel
    s = np.clip((x[:60] - model.fourier.mean) / model.fourier.scale, -8, 8)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(2) / (2 * s.shape[1]))
    f = model.fourier(x[:60])[:, :-1]
    assert np.abs(f @ f.T - kernel).mean() < 0.06


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 30))
        x, y, w = np.sort(rng.choice(200, n, replace=False)) / 7, rng.random(n).round(1), rng.integers(1, 5, n).astype(float)
        shuffled = rng.permutation(n)
        knots, values = quality.isotonic(x[shuffled], y[shuffled], w[shuffled])
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.interp(x, knots, values), want)


def test_toxicity_features_are_counted_over_everything(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    train = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and in_training(r.doc_id)}
    held = {d: set(toxicity.features(t).tolist()) for d, t in texts.items()}
    positives = [d for d, y in train.items() if y and d in texts]
    in_p = Counter(b for d in positives for b in held[d])
    in_u = Counter(b for s in held.values() for b in s)
    n_pos, prior = sum(train.values()), sum(train.values()) / len(train)
    surplus = {}
    for b, k in in_p.items():
        rate = (max(in_u[b], k) + 0.5) / (len(texts) + 1)
        value = (k - rate * n_pos) / np.sqrt(rate * n_pos + 1)
        if k >= toxicity.MIN_POSITIVES and prior * k / n_pos >= toxicity.MIN_SHARE * rate and value >= toxicity.MIN_SURPLUS:
            surplus[b] = value
    best = sorted(surplus, key=lambda b: (-surplus[b], b))[: toxicity.FEATURES]
    assert model.buckets.tolist() == sorted(best)
    # scores are those of the plain logistic model over the features present
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    for d in list(texts)[:200]:
        margin = model.bias + sum(weight[b] for b in held[d] if b in weight)
        assert abs(scored[d] - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-9


def test_non_negative_risk_falls():
    rng = np.random.default_rng(1)
    positive, negative = rng.random((300, 6)) < 0.6, rng.random((1700, 6)) < 0.1
    xp = positive[:200].astype(float)
    xu = np.vstack([positive[200:], negative]).astype(float)
    prior = 100 / 1800

    def risk(w, b):
        zp, zu = xp @ w + b, xu @ w + b
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    w, b = toxicity.fit_nnpu(xp, xu, prior)
    assert risk(w, b) < 0.5 * risk(np.zeros(6), np.log(prior / (1 - prior)))
    z = xu @ w + b
    assert z[:100].mean() > z[100:].mean() + 2


def test_contradicting_and_repeated_labels(spark, make_docs):
    docs, labels = tables(spark)
    doubled = labels.union(labels)
    plain, again = (toxicity.fit(docs, x) for x in (labels, doubled))
    assert again.buckets.tolist() == plain.buckets.tolist() and np.allclose(again.weights, plain.weights)
    # a row that contradicts makes the document toxic, whatever the order of the rows
    against = labels.where("toxic = 1").withColumn("toxic", F.lit(0))
    for both in (labels.union(against), against.union(labels)):
        assert np.allclose(toxicity.fit(docs, both).weights, plain.weights)
