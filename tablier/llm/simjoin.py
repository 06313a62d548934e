"""Operator 2: n-gram Jaccard join by token-combination prefixes.

Documents become sets of distinct word shingles. Identical sets form one class
and only one representative of a class is compared.

1. *Unshared-shingle count.* A pair at similarity t needs at least t*n shared
   shingles on either side, so a set that has more than n - ceil(t*n) shingles
   of its own can have no link. These are counted in one f-th of the hash
   space, f = 0.6 / (1 - t): too many there are too many in all, and texts
   of which 60 % or more is their own are dropped at an f-th of the shuffle.
   A set that stays is compared in full by the next steps, so nothing rests on
   the share. One packed shuffle of 48-bit shingle hashes counts them. Each
   batch first drops its own repeats, so a shingle of a third of all rows costs
   a slot one entry per batch. A slot returns one row per set with shared
   entries in it: at most the shared shingles of that share, however many slots
   there are. Hash collisions only keep sets that could have been dropped.
   A set that stands in several batches is counted once in each; its sum is
   held against the number of its batches, so repeats change nothing.
2. *Token classes.* Surviving sets get the exact number of holders of each
   shingle. Shingles with more than ``frequent`` holders are the frequent
   class, the others are rare; the common order is rare first.
3. *Extended prefixes.* With e = n - ceil(t*n) possible unshared shingles, u of
   them already known to be unshared, a linked pair shares c shingles within
   the first (e - u) + c of either side. c = (e_x - u_x) + (e_y - u_y) + 2 makes
   at least one gap between consecutive shared shingles free of unshared ones.
   So the pair meets on a rare single shingle, or, when the first c shared ones
   are all frequent, on a 2-shingle combination of neighbours in the order.
   The index stays linear in the prefix.
4. *Verification.* Every index key first links its members to one hub (linear
   in the key). Members in one component need no further test; what remains
   between different components of a key is tested pair by pair, at the first
   key that both share in the common order. What they share then lies from that
   key on: behind a rare shingle's place in either set, or, where the first key
   is a combination, among the frequent shingles alone. Pairs for which that is
   too little are not made. No link between components is lost, and groups of
   copies never make all pairs.

Results: null and empty texts get n_shingles 0 and their own id. Repeated rows
(equal doc_id) fold to one, of different texts to the one with the greatest
xxhash64; rows without doc_id name no document and are left out. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, returning_memory, shingle_set, sized_broadcast, text_or_empty

#: Entries that one batch of the counting shuffle gathers before it is packed.
BATCH_ENTRIES = 1 << 18
#: Text bytes of counted shingles behind one slot: about 500,000 entries, 5 to 13 MB packed.
SLOT_BYTES = 3 << 20
#: Slots of a small input: most sets have fewer shared entries than this, so more slots return no more rows.
MIN_SLOTS = 128
MARK = 0xFFFFFFFF
#: Keys by which a set tells whether a pair is made at an earlier key.
FIRST_KEYS = 8
#: Copies of one set from which it counts as common.
HOT_COPIES = 1_000


def _floor_unshared(n, num: int, den: int):
    """Largest number of shingles of a set of n that a linked partner may lack."""
    return n - (num * n + den - 1) // den


def _share(num: int, den: int) -> int:
    """The counting step reads one f-th of the hash space: f * (1 - t) is at most 0.6."""
    return max(1, 6 * den // (10 * (den - num))) if den > num else 8


def _pack(docs: list, keys: list, sizes: list, sets: list, slots: int) -> pd.DataFrame:
    lens = np.array([len(s) for s in sets])
    h = np.concatenate(sets) & np.uint64(0xFFFFFFFFFFFF)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint32), lens)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    run = np.cumsum(first) - 1
    many = np.bincount(run) > 1
    known = np.bincount(owner[many[run]], minlength=len(sets))
    keep = first | ~many[run]
    h, owner = h[keep], np.where(many[run], np.uint32(MARK), owner)[keep]
    slot = (h % np.uint64(slots)).astype(np.int64)
    by = np.argsort(slot, kind="stable")
    h, owner, slot = h[by], owner[by], slot[by]
    cut = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))) if len(slot) else np.empty(0, np.int64)
    key_a = np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        # only the sets that own an entry travel with a slot: its size follows its entries, however many slots there are
        who, at = np.unique(owner[a:b], return_inverse=True)
        at = np.where(owner[a:b] == MARK, MARK, at).astype(np.uint32)
        who = who[who != MARK] if who[0] != MARK else np.zeros(1, np.uint32)
        packed = h[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        rows.append((int(slot[a]), key_a[who].tobytes(), at.tobytes(), packed))
    out = pd.DataFrame(rows, columns=["slot", "keys", "owner", "hashes"])
    out["kind"] = 0
    lack = lens.astype(np.int64) - known.astype(np.int64)
    more = pd.DataFrame({"part": key_a.view(np.int64), "n": sizes, "lack": lack, "batches": 1})
    more["kind"], more["slot"] = 1, np.array(docs, np.int64) % slots
    return pd.concat([_packed_frame(out), _packed_frame(more)])


_PACKED = (
    "slot long, kind int, doc_id long, version long, n long, part long, lack long, batches long, "
    "set_key binary, keys binary, owner binary, hashes binary"
)
#: Numbers of the rows that a slot returns: of documents (kind 2), of sets by the first 64 bits of their key (kind 1).
#: They are 0, not null, where they say nothing: pandas would round long integers beside nulls.
_NUMBERS = ["doc_id", "version", "n", "part", "lack", "batches"]
_COUNTED = ["kind", *_NUMBERS, "set_key"]


def _packed_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    blank = {c: 0 for c in _NUMBERS} | {c: None for c in ("set_key", "keys", "owner", "hashes")}
    pdf = pdf.assign(**{c: v for c, v in blank.items() if c not in pdf})
    return pdf[["slot", "kind", *blank]]


def _set_packer(width: int, share: int, slots: int):
    below = np.uint64((1 << 64) // share - 1)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, keys, sizes, sets, seen, held = [], [], [], [], set(), 0
        for pdf in batches:
            rows = []
            for doc_id, version, text in zip(pdf["doc_id"], pdf["version"], pdf["text"]):
                s = shingle_set(text, width)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                part = int.from_bytes(key[:8], sys.byteorder, signed=True) if key else 0
                rows.append((int(doc_id), int(version), len(s), part, key))
                if key is not None and key not in seen:
                    seen.add(key)
                    docs.append(int(doc_id))
                    keys.append(key)
                    sizes.append(len(s))
                    sets.append(s[: np.searchsorted(s, below, "right")].copy())
                    held += len(sets[-1]) + 1
                if held >= BATCH_ENTRIES:
                    yield _pack(docs, keys, sizes, sets, slots)
                    docs, keys, sizes, sets, seen, held = [], [], [], [], set(), 0
            out = pd.DataFrame(rows, columns=["doc_id", "version", "n", "part", "set_key"])
            out["kind"], out["slot"] = 2, out["doc_id"] % slots
            yield _packed_frame(out)
        if sets:
            yield _pack(docs, keys, sizes, sets, slots)

    return pack


def _count_slot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per set: how many of its shingles in this slot occur in another set, over all its batches, to take from its lack."""
    own = pdf[pdf["kind"] != 0][_COUNTED]
    marks, keys, hashes = [], [], []
    for k, o, h in pdf.loc[pdf["kind"] == 0, ["keys", "owner", "hashes"]].itertuples(index=False):
        owner = np.frombuffer(o, np.uint32)
        wide = np.zeros((len(owner), 8), np.uint8)
        wide[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
        mark = owner == MARK
        marks.append(mark)
        keys.append(np.where(mark, np.uint64(0), np.frombuffer(k, np.uint64)[np.where(mark, 0, owner)]))
        hashes.append(wide.view(np.uint64).ravel())
    if not hashes:
        return own
    mark, key, h = (np.concatenate(x) for x in (marks, keys, hashes))
    order = np.argsort(h, kind="stable")
    mark, key, h = mark[order], key[order], h[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
    mixed = (np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)) | np.logical_or.reduceat(mark, start)
    sets, counts = np.unique(key[mixed[run] & ~mark], return_counts=True)
    found = pd.DataFrame({"slot": 0, "kind": 1, "part": sets.view(np.int64), "lack": -counts})
    return pd.concat([own, _packed_frame(found)[_COUNTED]])


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [shingle_set(t, width) for t in pdf["text"]]
            yield pd.DataFrame(
                {"rep": pdf["doc_id"].astype("int64"), "n": [len(x) for x in s], "hashes": [x.tobytes() for x in s]}
            )

    return run


def _explode_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for rep, n, b in zip(pdf["rep"], pdf["n"], pdf["hashes"]):
            h = np.frombuffer(b, np.int64)
            yield pd.DataFrame({"h": h, "rep": rep, "n": n})


def _index(num: int, den: int, frequent: int):
    mult = 0x9E3779B97F4A7C15

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rep, n, tokens, holders in zip(pdf["rep"], pdf["n"], pdf["tokens"], pdf["holders"]):
                h, df = np.asarray(tokens, np.int64), np.asarray(holders, np.int64)
                m = len(h)
                free = _floor_unshared(n, num, den) - (n - m)
                if free < 0:
                    continue
                rare = df <= frequent
                frequents = m - int(rare.sum())
                order = np.lexsort((h, ~rare))
                # the partner holds at most n*den/num shingles
                partner = _floor_unshared(n * den // num, num, den)
                length = min(m, free + (free + partner + 2))
                h, rare = h[order][:length], rare[order][:length]
                singles = h[rare][: max(free + 2, 0)] if rare.all() else h[rare]
                f = h[~rare].astype(np.uint64)
                combos = ((f[:-1] * np.uint64(mult)) ^ (f[1:] + np.uint64(mult))).astype(np.int64)
                keys = np.concatenate((singles, combos))
                if len(keys):
                    # kind and token give the common order; rest is what a pair that first meets here can share
                    kind = np.repeat([0, 1], [len(singles), len(combos)]).astype(np.int32)
                    token = np.concatenate((singles, f[:-1].astype(np.int64)))
                    rest = np.where(kind == 0, m - np.arange(len(keys)), frequents)
                    yield pd.DataFrame({"key": keys, "rep": rep, "n": n, "m": m, "kind": kind, "token": token, "rest": rest})

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)) for a, b in zip(pdf["ha"], pdf["hb"])]
            inter = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in x], np.int64)
            union = np.array([len(a) + len(b) for a, b in x], np.int64) - inter
            ok = den * inter >= num * union
            yield pd.DataFrame({"a": pdf["a"][ok], "b": pdf["b"][ok]})

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb")
    return materialize(full.mapInPandas(returning_memory(_verified(num, den)), "a long, b long"), name)


def _possible(num: int, den: int, m: str = "m") -> str:
    """Bound from sizes n and counts m of shingles that any other set holds, or that a pair can share at a key."""
    return f"{den} * least({m}, {m}2) >= {num} * (n + n2 - least({m}, {m}2))"


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, frequent: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the graph of pairs with Jaccard >= num/den.

    ``docs`` needs doc_id and text. See the module's text for method and edge cases.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("doc_id IS NOT NULL")
    docs = docs.withColumn("version", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = _share(num, den)
    slots = max(MIN_SLOTS, size // (SLOT_BYTES * share) + 1)

    packed = docs.mapInPandas(returning_memory(_set_packer(width, share, slots)), _PACKED)
    counted = materialize(
        packed.groupBy("slot").applyInPandas(
            lambda key, pdf: _count_slot(pdf),
            "kind int, doc_id long, version long, n long, part long, lack long, batches long, set_key binary",
        ),
        "simjoin-counts",
    )
    newest = F.max(F.struct("version", "n", "part", "set_key")).alias("r")
    rows = counted.where("kind = 2").groupBy("doc_id").agg(newest).select("doc_id", "r.*")
    # a set is packed once in each of its batches and lacks the same in all of them
    lack = counted.where("kind = 1").groupBy("part").agg(F.max("n").alias("m"), F.sum("lack").alias("lack"), F.sum("batches").alias("batches"))
    passed = lack.where((F.col("m") * F.col("batches") - F.col("lack")) * den >= F.col("m") * num * F.col("batches")).select("part")
    first = F.min(F.struct("doc_id", "version", "part")).alias("r")
    reps = materialize(
        rows.where("n > 0").groupBy("set_key").agg(first, F.count("*").alias("copies")).select("set_key", F.col("r.doc_id").alias("rep"), "r.version", "r.part", "copies"),
        "simjoin-reps",
    )
    kept = reps.join(passed, "part").select(F.col("rep").alias("doc_id"), "version")
    kept = materialize(kept, "simjoin-kept")
    n_kept = kept.count()

    # sets with many copies are looked up without a shuffle; rows that need no other lookup are spread by their id
    common = reps.where(F.col("copies") > HOT_COPIES).select("set_key", F.col("rep").alias("common_rep"))
    looked = rows.join(sized_broadcast(common, common.count()), "set_key", "left")
    lone = F.encode(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), "UTF-8")
    looked = looked.withColumn("set_key", F.when(F.col("common_rep").isNull() & (F.col("n") > 0), F.col("set_key")).otherwise(lone))
    members = looked.join(reps.where(F.col("copies") <= HOT_COPIES).select("set_key", "rep"), "set_key", "left").select(
        "doc_id", "n", F.coalesce("common_rep", "rep", "doc_id").alias("rep")
    )
    if not n_kept:
        return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))

    sets = materialize(
        docs.join(sized_broadcast(kept, n_kept), ["doc_id", "version"], "left_semi")
        .dropDuplicates(["doc_id"])
        .mapInPandas(returning_memory(_sets(width)), "rep long, n long, hashes binary"),
        "simjoin-sets",
    )
    tokens = sets.mapInPandas(returning_memory(_explode_sets), "h long, rep long, n long")
    holders = tokens.groupBy("h").agg(F.count("*").alias("holders")).where("holders > 1")
    lists = (
        tokens.join(holders, "h")
        .groupBy("rep", "n")
        .agg(F.collect_list(F.struct("h", "holders")).alias("t"))
        .select("rep", "n", F.col("t.h").alias("tokens"), F.col("t.holders").alias("holders"))
    )
    index = materialize(lists.mapInPandas(returning_memory(_index(num, den, frequent)), "key long, rep long, n long, m long, kind int, token long, rest long"), "simjoin-index")

    hubs = (
        index.groupBy("key")
        .agg(F.min(F.struct(F.expr("n - m"), "rep", "n", "m")).alias("hub"), F.count("*").alias("c"))
        .where("c > 1")
        .select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("n2"), F.col("hub.m").alias("m2"))
    )
    star = (
        index.join(hubs, "key")
        .where("rep <> hub")
        .where(_possible(num, den))
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        .distinct()
    )
    links = _links(star, sets, num, den, "simjoin-star")
    comp = materialize(components(links), "simjoin-comp")

    tagged = index.join(comp, index.rep == comp.id, "left").select(
        "key", "rep", "n", "m", "kind", "token", "rest", F.coalesce("comp", "rep").alias("comp")
    )
    open_keys = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = materialize(tagged.join(open_keys, "key"), "simjoin-open")
    # the first keys of a set: a pair that shares some of them is made at the first of those alone
    nth = Window.partitionBy("rep").orderBy("kind", "token", "key")
    few = left.withColumn("r", F.row_number().over(nth)).where(F.col("r") <= FIRST_KEYS)
    first = [F.min(F.when(F.col("r") == i + 1, F.col("key"))).alias(f"first{i}") for i in range(FIRST_KEYS)]
    left = left.join(few.groupBy("rep").agg(*first), "rep")
    other = left.select("key", *[F.col(c).alias(f"other_{c}") for c in left.columns if c != "key"])
    other = other.withColumnsRenamed({"other_rep": "rep2", "other_n": "n2", "other_m": "m2", "other_comp": "comp2", "other_rest": "rest2"})
    theirs = ", ".join(f"other_first{i}" for i in range(FIRST_KEYS))
    earliest = " ".join(f"WHEN first{i} IN ({theirs}) THEN first{i}" for i in range(FIRST_KEYS))
    rest = (
        left.join(other, "key")
        .where("rep < rep2 AND comp <> comp2")
        .where(_possible(num, den, "rest"))
        .where(f"key = CASE {earliest} ELSE key END")
        .select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
        .distinct()
    )
    links = links.union(_links(rest, sets, num, den, "simjoin-rest"))
    comp = materialize(components(links), "simjoin-comp")
    return members.join(comp, members.rep == comp.id, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id")
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda p: array_to_string(ws[p:p + 3], ' '))) AS s
       FROM w WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
 r(doc_id, node) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
