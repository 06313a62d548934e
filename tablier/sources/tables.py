"""Readers for the shared parquet tables and the modelling views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to customer (many-to-one on o_custkey).

    customer is 1/10 of orders; at scale this is a shuffle join on custkey
    (AQE turns it into a broadcast only when the filtered side is small).
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").drop("c_custkey")


def labels_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id", "inner")


ORDERS_CUSTOMER_SQL = (
    "(SELECT o.*, c.c_acctbal, c.c_mktsegment, c.c_nationkey "
    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"
)
LABELS_DOCUMENTS_SQL = (
    "(SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
)


def embedding_columns(df: DataFrame, col: str = "embedding", dims: int = 64, prefix: str = "e") -> DataFrame:
    """Expand an array<float> column into DOUBLE columns e0..e{dims-1}."""
    return df.select(
        *[c for c in df.columns if c != col],
        *[F.col(col)[i].cast("double").alias(f"{prefix}{i}") for i in range(dims)],
    )
