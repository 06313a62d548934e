"""Write an N-times replicated copy of a scale-factor folder with fresh keys.

usage: python scripts/replicate.py SRC_DIR DST_DIR [N]

Copy i shifts every key (and every foreign key pointing at it) by
i * (max key + 1), so joins, groups and uniqueness behave as in a table N
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tablier.session import build_session  # noqa: E402
from tablier.sources.tables import TABLES  # noqa: E402

# key column -> key family; columns of one family are shifted together
FAMILIES = {
    "c_custkey": "cust", "o_custkey": "cust",
    "o_orderkey": "order", "l_orderkey": "order",
    "p_partkey": "part", "l_partkey": "part",
    "s_suppkey": "supp", "l_suppkey": "supp",
    "event_id": "event", "user_id": "user",
    "doc_id": "doc", "vec_id": "vec", "page_id": "page", "item_id": "item", "conv_id": "conv",
}


def main():
    src, dst = sys.argv[1], sys.argv[2]
    n = int(sys.argv[3]) if len(sys.argv) > 3 else 10
    spark = build_session("local[8]", 8, app="replicate")
    spark.sparkContext.setLogLevel("ERROR")
    frames = {t: spark.read.parquet(f"{src}/{t}.parquet") for t in TABLES}
    span = {}
    for t, df in frames.items():
        for c in df.columns:
            fam = FAMILIES.get(c)
            if fam:
                m = df.agg(F.max(c)).collect()[0][0] or 0
                span[fam] = max(span.get(fam, 0), int(m) + 1)
    for t, df in frames.items():
        keyed = [c for c in df.columns if c in FAMILIES]
        if not keyed:  # lookup tables (region, nation) stay as they are
            df.coalesce(1).write.mode("overwrite").parquet(f"{dst}/{t}.parquet")
            continue
        copies = spark.range(n).withColumnRenamed("id", "_copy")
        out = df.crossJoin(F.broadcast(copies))
        for c in keyed:
            out = out.withColumn(c, (F.col(c) + F.col("_copy") * F.lit(span[FAMILIES[c]])).cast(df.schema[c].dataType))
        out.drop("_copy").write.mode("overwrite").parquet(f"{dst}/{t}.parquet")
        print(t, "done")
    spark.stop()


if __name__ == "__main__":
    main()
