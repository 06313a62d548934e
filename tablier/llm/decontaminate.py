"""Operator 1 [native]: benchmark decontamination by size-partitioned MinHash containment.

Only DataFrame functions. Benchmark items are partitioned by size: class c
holds items of 2^c to 2^(c+1)-1 distinct shingles and gives each a bottom-k
MinHash signature, its k smallest shingle hashes, with k one more than an item
of that class may miss. A text that contains num/den of the item then holds at
least one hash of the signature, so the search loses no match. Each class is an
index of its own with its own limit, the largest hash of its signatures:
documents send a class only hashes up to its limit, which lies low for classes
of long items. Candidates are verified by exact shingle containment in the
whole text.

Items shorter than ``width`` words are one shingle of their own length, and
texts are then also cut at that length. Null and empty texts and items match
nothing. Equal item texts of different ids are all reported. Repeated rows of a
table (equal id and text) count once. Rows of one id with different texts are
texts of their own: a document row must contain the item by itself, an item_id
with several texts gives a result row per text, and a doc_id is reported with
its best row. Rows without an id are left out. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast, text_or_empty

_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def _words(col: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(col)), _SPLIT), "")


def _shingles(words: Column, width: int) -> Column:
    """Hashes of the ``width``-word shingles; the words are bound once by the outer transform."""
    none = F.array().cast("array<bigint>")
    cut = lambda ws: F.when(
        F.size(ws) >= width,
        F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[ws[i + j] for j in range(width)])),
    ).otherwise(none)
    return F.transform(F.array(words), cut)[0]


def _item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, item, width, h, n): the distinct shingles of each item text and their number."""
    cut = items.select("item_id", F.xxhash64("text").alias("item"), _words("text").alias("words")).withColumn("width", F.least(F.size("words"), F.lit(width)))
    per_width = F.when(F.col("width") == width, _shingles(F.col("words"), width))
    for w in range(1, width):
        per_width = per_width.when(F.col("width") == w, _shingles(F.col("words"), w))
    hashes = cut.where("width > 0").select("item_id", "item", "width", F.array_distinct(per_width).alias("hashes"))
    hashes = hashes.dropDuplicates(["item_id", "item"])
    return hashes.select("item_id", "item", "width", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))


def _allowed(n: str, num: int, den: int) -> str:
    """One more than the shingles that a match may miss."""
    return f"({n} - ({num} * {n} + {den - 1}) div {den} + 1)"


def signatures(shingles: DataFrame, num: int, den: int) -> DataFrame:
    """Bottom-k MinHash values per item text, k fixed by the item's size class."""
    return (
        shingles.groupBy("item_id", "item", "width", "n")
        .agg(F.sort_array(F.collect_set("h")).alias("hashes"))
        .withColumn("size_class", F.expr("int(floor(log2(n)))"))
        .withColumn("top", F.expr("int(shiftleft(2, size_class)) - 1"))
        .withColumn("k", F.expr(f"int(least(n, greatest({_allowed('n', num, den)}, top * {den - num} div {den} + 1)))"))
        .select("item_id", "item", "width", "size_class", "n", F.explode(F.expr("slice(hashes, 1, k)")).alias("h"))
    )


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): items of which num/den lies in the document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("doc_id IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).where("item_id IS NOT NULL")
    full = materialize(_item_shingles(items, width), "decon-items")
    sig = materialize(signatures(full, num, den), "decon-signatures")
    # at most ``width`` sizes of shingles and 31 size classes
    limits = sig.groupBy("width", "size_class").agg(F.max("h")).collect()
    if not limits:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_found long")
    n_full = full.count()
    widths = sorted({w for w, _, _ in limits})
    rows = docs.withColumn("row", F.xxhash64("text"))

    def shares(w: int, classes: bool):
        """From a text's distinct shingles of ``w`` words to what each class (or the verification) receives."""
        if not classes:
            return lambda hs: F.array(F.struct(F.lit(w).alias("width"), hs.alias("hs")))
        tops = [(c, top) for lw, c, top in sorted(limits) if lw == w]
        up_to = lambda hs, top: F.filter(hs, lambda x: x <= top)
        return lambda hs: F.array(*[F.struct(F.lit(w).alias("width"), F.lit(c).alias("size_class"), up_to(hs, top).alias("hs")) for c, top in tops])

    def hashes(text_rows: DataFrame, classes: bool) -> DataFrame:
        """(doc_id, row, width[, size_class], h): the shingles of the texts, for the search those up to each class's limit."""
        # the outer transform binds a text's shingles once for all classes
        per_width = [F.transform(F.array(F.array_distinct(_shingles(_words("text"), w))), shares(w, classes))[0] for w in widths]
        per = text_rows.select("doc_id", "row", F.explode(F.concat(*per_width)).alias("s"))
        keys = ["s.width", "s.size_class"] if classes else ["s.width"]
        return per.select("doc_id", "row", *keys, F.explode("s.hs").alias("h"))

    index = sized_broadcast(sig.select("item_id", "item", "width", "size_class", "h"), n_full)
    found = hashes(rows, True).join(index, ["width", "size_class", "h"])
    candidates = materialize(found.select("doc_id", "row", "item_id", "item").distinct(), "decon-candidates")
    ids = candidates.select("doc_id", "row").distinct()
    texts = rows.join(sized_broadcast(ids, ids.count()), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    hits = hashes(texts, False).join(sized_broadcast(full, n_full), ["width", "h"])
    return (
        hits.groupBy("doc_id", "row", "item_id", "item", "n")
        .agg(F.count("*").alias("n_found"))
        .where(f"n_found * {den} >= n * {num}")
        .join(candidates, ["doc_id", "row", "item_id", "item"], "left_semi")
        .groupBy("doc_id", "item_id", "item", F.col("n").cast("long").alias("n_shingles"))
        .agg(F.max("n_found").alias("n_found"))
        .drop("item")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
 i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM benchmark),
 s AS (SELECT DISTINCT item_id, w, unnest(list_transform(range(1, len(ws) - w + 2), lambda p: array_to_string(ws[p:p + w - 1], ' '))) AS g
       FROM (SELECT item_id, ws, least(5, len(ws)) AS w FROM i) WHERE w > 0),
 n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
 g AS (SELECT DISTINCT doc_id, w, unnest(list_transform(range(1, len(ws) - w + 2), lambda p: array_to_string(ws[p:p + w - 1], ' '))) AS g
       FROM d, (SELECT DISTINCT w FROM s))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found
FROM g JOIN s USING (w, g) JOIN n USING (item_id)
GROUP BY ALL HAVING count(*) * 10 >= n * 8
"""
