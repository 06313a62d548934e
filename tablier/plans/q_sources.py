"""Source / sink round trips (A1-A5, A6) and streaming scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import models as M
from ..session import scratch_path
from ..sources import loader, sinks
from ..sources.tables import table
from ..streaming.scoring import file_stream, run_to_table
from .q_eval import CUT, FEATS, NB_SQL
from .registry import register


def _scratch(spark, what):
    return scratch_path(spark, f"{what}-{uuid.uuid4().hex}")


@register("feather_scan", "SELECT event_id, user_id, event_type, value, props FROM events")
def q_feather_scan(spark, sf):
    ev = table(spark, sf, "events")
    folder = _scratch(spark, "feather-events")
    written = sinks.write_feather_parts(ev, folder).agg(F.sum("rows")).first()[0]
    back = loader.read_feather(spark, folder)
    if back.count() != written:
        raise ValueError("The feather files do not hold the rows that were written.")
    return back.select("event_id", "user_id", "event_type", "value", "props")


@register("csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate,
       o_orderpriority FROM orders""")
def q_csv_roundtrip(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate").cast("string"))
    path = _scratch(spark, "csv-orders") + ".csv"
    o.write.mode("overwrite").option("header", "true").csv(path)
    return loader.load_dataset(spark, path)


@register("infer_csv_types", """
SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'),
 ('o_orderdate', 'string'), ('o_orderpriority', 'string')) AS t("column", type)""")
def q_infer_csv_types(spark, sf):
    df = q_csv_roundtrip(spark, sf)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")


@register("modeling_subset", "SELECT o_orderpriority, o_totalprice, o_orderstatus FROM orders")
def q_modeling_subset(spark, sf):
    o = table(spark, sf, "orders")
    path = _scratch(spark, "subset")
    sinks.write_modeling_subset(o, ["o_orderpriority", "o_totalprice"], "o_orderstatus", path)
    back = spark.read.parquet(path)
    if back.columns != ["o_orderpriority", "o_totalprice", "o_orderstatus"]:
        raise ValueError("Saved modeling subset header does not match features + target.")
    return back


@register("stream_scoring", f"WITH {NB_SQL}\nSELECT * FROM sc")
def q_stream_scoring(spark, sf):
    from ..sources.tables import orders_customer

    df = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderdate", *FEATS)
    train = df.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))
    model = M.fit_gaussian_nb(train, FEATS, "o_orderstatus")
    schema = table(spark, sf, "orders").schema
    stream = file_stream(spark, sf, schema, glob="orders.parquet")
    cust = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    rows = (
        stream.where(F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))  # stream-static join
        .select("o_orderkey", F.col("o_orderstatus").alias("actual"), *FEATS)
    )
    scored = M.predict_gaussian_nb(rows, model).select("o_orderkey", "actual", "predicted", *[f"p_{c}" for c in model.classes])
    return run_to_table(scored, "nb")


@register("csv_text_roundtrip", r"""
SELECT doc_id, trim(text) AS text, lang FROM documents""")
def q_csv_text_roundtrip(spark, sf):
    """A2: whole texts with line breaks and quotes survive a CSV file; files without such records stay splittable."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = _scratch(spark, "csv-texts") + ".csv"
    # the writer keeps outer blanks and doubles inner quotes, as the reader expects
    opts = {"header": "true", "escape": '"', "quoteAll": "true"}
    d.where("text LIKE '%\n%'").write.options(**opts).csv(path + "/spanning")
    d.where("text NOT LIKE '%\n%'").write.options(**opts).csv(path + "/flat")
    back = None
    for part in ("spanning", "flat"):
        rows, _ = loader.read_csv_text(spark, f"{path}/{part}")
        back = rows if back is None else back.unionByName(rows)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.btrim("text", F.lit(" ")).alias("text"), "lang")
