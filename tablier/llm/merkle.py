"""Operator 11: Merkle manifest of a dataset, with proofs by descent of a content-addressed DAG.

Build: every row is a leaf (``leaf_digest``). Leaves of a language are ranked by
doc_id, runs of ``FANOUT`` consecutive nodes become their digest until one node,
the subroot, is left; the subroots, ordered by language, become the root in the
same way. Each inner node is stored as a record digest -> children, in a folder
per distance from the root. Nothing but the records says where a leaf hangs.

Proof: a request is a leaf's address, the digits of the language's rank and of
the leaf's rank. All requests start at the root. At each step the nodes still
asked for are joined with the records of that distance on their digest, every
request prefix picks the child of its next digit, and the children not picked
are appended to its path as one segment. Requests with a common prefix descend
as one row, so a level of the descent has as many rows as nodes asked for. A
leaf's proof is its path with the segments reversed (leaf level first); folding
a leaf through them gives the root that they prove.

Ranks need no window over a language: rows are range-partitioned, sorted and
numbered, and only one row per language and partition is summed. A language
with a third of all rows is so split by doc_id, equal rows by a stored number.

Nulls hash as ``-``; the null language is a language of its own and comes first.
Rows with a null doc_id come first in their language and are never tampered
with. Equal rows (and equal doc_ids, ordered by leaf digest) stay and have their
own places and proofs. An empty table has no root and gives no rows; a lone
leaf is its subroot, and a lone subroot the root, with an empty proof. Texts of
any length are hashed whole. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast hint for a counted, small table; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _digest(parts: Column) -> Column:
    return F.sha2(F.concat_ws("", parts), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row: each field as byte count, colon and value, or ``-`` if null."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, g, leaf, altered, salt): ``g`` names the language in its order, ``altered`` is the tampered leaf or null."""
    docs = docs.select(*FIELDS)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    lowered = F.translate("text", _UPPER, _LOWER)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("g"),
        leaf_digest().alias("leaf"),
        F.when(hit, leaf_digest(lowered)).alias("altered"),
        F.monotonically_increasing_id().alias("salt"),
    )


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) and ``n`` within the groups ``g``, ordered by ``order``."""
    keys = [F.asc_nulls_first(c) for c in ("g", *order)]
    at = F.monotonically_increasing_id()  # partition number above, place in the partition below
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at), name)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("g", "part")
        .agg(F.count("*").alias("c"), F.min("at").alias("first_at"))
        .select("g", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first_at")).alias("shift"), "c")
    )
    offsets = materialize(offsets.withColumn("n", F.sum("c").over(Window.partitionBy("g"))).drop("c"), name)
    return placed.join(_sized(offsets), ["g", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _depth(n: Column) -> Column:
    """Levels above ``n`` nodes: the octal digits of the last rank."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, 8))).otherwise(0)


def _digits(rank: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.lpad(F.conv(rank.cast("string"), 10, 8), depth, "0")).otherwise("")


def _tree(nodes: DataFrame, levels: int, records: list[DataFrame], name: str) -> DataFrame:
    """(g, h): the digest that is left of each group of ``nodes(g, idx, n, step, h)``; appends the records made."""
    done = nodes.where("n = 1").select("g", "h")
    for _ in range(levels):
        runs = (
            nodes.where("n > 1")
            .groupBy("g", F.expr(f"idx div {FANOUT}").alias("idx"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("run"), F.first("n").alias("n"), F.first("step").alias("step"))
            .withColumn("children", F.col("run.h"))
            .select(
                "g",
                "idx",
                F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
                (F.col("step") - 1).alias("step"),
                _digest(F.col("children")).alias("h"),
                "children",
            )
        )
        nodes = materialize(runs, name)
        records.append(nodes.select("step", F.col("h").alias("digest"), "children"))
        done = done.union(nodes.where("n = 1").select("g", "h"))
    return done


def _segment(children: str, digit: str) -> Column:
    """The children that were not picked, in order, parted at the picked one."""
    return F.expr(
        f"struct(slice({children}, 1, {digit}) AS before, slice({children}, {digit} + 2, greatest(size({children}) - {digit} - 1, 0)) AS after)"
    )


_PATH = "array<struct<before:array<string>,after:array<string>>>"


def descend(records: list[DataFrame], root: str, requests: DataFrame, levels: int) -> DataFrame:
    """(addr, children, path) of the nodes just above the requested leaves; ``requests`` has the column ``addr``."""
    spark = requests.sparkSession
    parents = requests.where("addr <> ''").select(F.expr("substring(addr, 1, length(addr) - 1)").alias("addr")).distinct()
    prefixes = parents.select(F.explode(F.expr("transform(sequence(0, length(addr)), i -> substring(addr, 1, i))")).alias("addr")).distinct()
    wanted = materialize(prefixes.withColumn("step", F.length("addr")), "merkle-wanted")
    front = spark.createDataFrame([("", root)], "addr string, digest string").withColumn("path", F.array().cast(_PATH))
    opened: list[DataFrame] = []
    for step in range(levels):
        if opened:
            asked = wanted.where(F.col("step") == step).select(
                F.col("addr").alias("to"), F.expr(f"substring(addr, 1, {step - 1})").alias("addr"), F.expr(f"int(substring(addr, {step}, 1))").alias("d")
            )
            front = asked.join(opened[-1], "addr").select(
                F.col("to").alias("addr"), F.expr("children[d]").alias("digest"), F.concat("path", F.array(_segment("children", "d"))).alias("path")
            )
        store = None
        for made in records:
            part = made.where(F.col("step") == step).select("digest", "children")
            store = part if store is None else store.union(part)
        # equal content has one record, however often it occurs
        opened.append(materialize(front.join(store.dropDuplicates(["digest"]), "digest").select("addr", "children", "path"), "merkle-open"))
    out = opened[0]
    for more in opened[1:]:
        out = out.union(more)
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof digest and folded root of every row of ``docs``."""
    spark = docs.sparkSession
    placed = ranked(materialize(leaves(docs), "merkle-leaves"), ["doc_id", "leaf", "salt"], "merkle-ranked")
    sizes = placed.groupBy("g").agg(F.first("n").alias("size")).withColumnRenamed("g", "lang_g").withColumn("g", F.lit(""))
    groups = ranked(sizes, ["lang_g"], "merkle-groups").select(
        F.col("lang_g").alias("g"), F.col("rank").alias("group_rank"), F.col("n").alias("groups"), _depth(F.col("size")).alias("depth"), _depth(F.col("n")).alias("top")
    )
    groups = materialize(groups, "merkle-groups")
    deepest = groups.agg(F.max("depth"), F.max("top"), F.max(F.col("depth") + F.col("top"))).first()
    if deepest[0] is None:
        return spark.createDataFrame([], RESULT)
    placed = placed.join(_sized(groups), "g")
    records: list[DataFrame] = []
    subroots = _tree(
        placed.select("g", F.col("rank").alias("idx"), "n", (F.col("top") + F.col("depth")).alias("step"), F.col("leaf").alias("h")),
        deepest[0],
        records,
        "merkle-nodes",
    )
    subroots = materialize(subroots, "merkle-subroots")
    tops = subroots.join(_sized(groups), "g").select(
        F.lit("").alias("g"), F.col("group_rank").alias("idx"), F.col("groups").alias("n"), F.col("top").alias("step"), "h"
    )
    root = _tree(tops, deepest[1], records, "merkle-tops").first().h

    addr = F.concat(_digits(F.col("group_rank"), F.col("top")), _digits(F.col("rank"), F.col("depth")))
    requests = placed.join(_sized(subroots.withColumnRenamed("h", "subroot")), "g").select(
        "doc_id", "leaf", "subroot", "altered", addr.alias("addr"), F.expr("substring(addr, 1, length(addr) - 1)").alias("above")
    )
    if deepest[2]:
        nodes = descend(records, root, requests.select("addr"), deepest[2])
        nodes = nodes.select(F.col("addr").alias("above"), "children", "path")
        asked = requests.withColumn("d", F.expr("int(right(addr, 1))"))
        found = asked.join(nodes, "above").select(
            "doc_id",
            F.expr("children[d]").alias("leaf"),
            "subroot",
            "altered",
            F.reverse(F.concat("path", F.array(_segment("children", "d")))).alias("path"),
        )
    else:  # a lone row is its own root
        found = requests.select("doc_id", "leaf", "subroot", "altered", F.array().cast(_PATH).alias("path"))
    siblings = F.flatten(F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    folded = F.aggregate(
        "path",
        F.coalesce("altered", "leaf"),
        lambda acc, s: F.sha2(F.concat_ws("", s["before"], F.array(acc), s["after"]), 256),
    )
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), _digest(siblings).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# ---------------------------------------------------------------- the same in DuckDB


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII ``text`` expression (DuckDB has no such function)."""
    # fixed value: 3988292384 is the reflected polynomial of crc32
    step = "CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END"
    byte = f"list_reduce(list_prepend(xor(acc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda z, unused: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, c: {byte}), 4294967295::BIGINT)"


def _tree_sql(name: str, levels: int) -> str:
    """``levels`` levels above the table ``{name}0(g, r, n, h)``; a group of one node keeps its digest."""
    out = []
    for k in range(1, levels + 1):
        out.append(
            f"{name}r{k} AS (SELECT g, r // 8 AS r, any_value(n) AS n, list(h ORDER BY r) AS run FROM {name}{k - 1} GROUP BY g, r // 8),\n"
            f" {name}{k} AS (SELECT g, r, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}r{k})"
        )
    return ",\n ".join(out)


def _fold_sql(source: str, name: str, levels: int, rank: str, group: str, tag: str) -> str:
    """Tables that add each level's siblings to ``proof`` and fold ``acc``."""
    out, prev = [], source
    for k in range(1, levels + 1):
        pos = f"(p.{rank} // {8 ** (k - 1)}) % 8"
        left, right = f"array_to_string(t.run[1:{pos}], '')", f"array_to_string(t.run[{pos} + 2:], '')"
        out.append(
            f"{tag}{k} AS (SELECT p.* REPLACE (p.proof || {left} || {right} AS proof,\n"
            f"  CASE WHEN t.n > 1 THEN sha256({left} || p.acc || {right}) ELSE p.acc END AS acc)\n"
            f"  FROM {prev} p JOIN {name}r{k} t ON t.g = {group} AND t.r = p.{rank} // {8**k})"
        )
        prev = f"{tag}{k}"
    return ",\n ".join(out)


def oracle(levels: int = 7, top_levels: int = 3) -> str:
    """For up to 8^levels rows a language and 8^top_levels languages."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"

    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH d0 AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf,
   CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lowered)} END AS altered FROM documents),
 d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM d0),
 a0 AS (SELECT g, r, n, leaf AS h FROM d),
 {_tree_sql("a", levels)},
 s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gr, count(*) OVER () AS gn FROM a{levels}),
 b0 AS (SELECT '' AS g, gr AS r, gn AS n, subroot AS h FROM s),
 {_tree_sql("b", top_levels)},
 f0 AS (SELECT d.doc_id, d.g, d.r, s.gr, d.leaf, s.subroot, '' AS proof, coalesce(d.altered, d.leaf) AS acc FROM d JOIN s USING (g)),
 {_fold_sql("f0", "a", levels, "r", "p.g", "f")},
 {_fold_sql(f"f{levels}", "b", top_levels, "gr", "''", "e")}
SELECT doc_id, leaf, subroot, b{top_levels}.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = b{top_levels}.h AS verified
FROM e{top_levels}, b{top_levels}
"""


ORACLE = oracle()
