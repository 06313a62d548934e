"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet and reread as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
Rows without doc_id pass the filtering stages as far as their text allows;
null texts are clean, have no duplicates and encode to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablier.llm import chunkbpe, decontaminate, pii, simjoin, toxicity
from tablier.llm.common import documents, materialize, sized_broadcast, text_or_empty
from tablier.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return toxicity.keep_clean(docs, documents(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, Jaccard 0.8 or more; the smallest doc_id stays.

    Rows of one doc_id count as one document, that of the largest text hash, as
    in the join itself; only rows whose doc_id repeats are shuffled for that.
    """
    groups = simjoin.jaccard_components(docs, width=5, num=8, den=10)
    others = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-duplicates")
    kept = docs.join(sized_broadcast(others, others.count()), "doc_id", "left_anti").select(*docs.columns)
    again = materialize(docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id"), "pipeline-repeated")
    n_again = again.count()
    if not n_again:
        return kept
    hint = sized_broadcast(again, n_again)
    latest = Window.partitionBy("doc_id").orderBy(F.desc(F.xxhash64(text_or_empty())), F.desc("text"))
    one = kept.join(hint, "doc_id", "left_semi").select(*docs.columns).withColumn("_nth", F.row_number().over(latest)).where("_nth = 1")
    return kept.join(hint, "doc_id", "left_anti").select(*docs.columns).unionByName(one.drop("_nth"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, documents(spark, sf_dir, "benchmark"))
    ids = materialize(found.select("doc_id").distinct(), "pipeline-contaminated")
    return docs.join(sized_broadcast(ids, ids.count()), "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every text that is left."""
    return chunkbpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode),
]

#: SQL cannot express the classifier, the trees and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
