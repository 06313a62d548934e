"""The pipeline's stages on null, empty, repeated and clashing rows, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

FILTERS = P.STAGES[:-1]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_tables(spark, sf001, make_docs, name, stage):
    out = stage(spark, make_docs([]), sf001)
    assert out.count() == 0


def test_repeated_rows_and_ids_leave_one_row(spark, sf001, make_docs):
    text = "these are seven words and some more of them here"
    other = "an entirely different text with words of its own in it"
    docs = make_docs([text, text, text, other, other + " x", "", "", None, "lone"], [1, 1, 1, 2, 2, 3, 3, 4, None])
    out = P.drop_near_duplicates(spark, docs.repartition(3), sf001).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 3, 4]
    assert {r.text for r in out if r.doc_id == 2} <= {other, other + " x"}


def test_clashing_columns_and_null_ids_pass(spark, sf001, make_docs):
    texts = ["a clean text of a few words", None, "", "word " * 30_000, "another clean text"]
    docs = make_docs(texts, [1, 2, 3, 4, None])
    for c in ("h", "n", "key", "score", "row", "rep", "version", "count"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in FILTERS:
        out = stage(spark, docs, sf001)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None}, name
    assert P.STAGES[-1][1](spark, docs, sf001).count() >= 4
