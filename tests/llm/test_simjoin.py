import random
import re

import duckdb
import pytest

from tablier.llm.simjoin import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            if sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if den * inter >= num * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("frequent", [2, 32])
@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 8, 10)])
def test_matches_brute_force(spark, make_docs, frequent, k, num, den):
    rng = random.Random(7)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        passage = [word() for _ in range(30)]
        for _ in range(rng.choice([2, 5, 15])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 16)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += passage
            texts.append((" " if rng.random() < 0.9 else "\n\t ").join(w))
    texts += ["", None, "one", "One", "one two", "A b c", "a B c", "  ", "Ä b c d e", "ä b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(jaccard_components(make_docs(texts), k, num, den, frequent)) == brute(rows, k, num, den)


def test_tables_without_links(spark, make_docs):
    assert got(jaccard_components(make_docs([]))) == {}
    assert got(jaccard_components(make_docs([None, ""]))) == {0: (0, 0), 1: (0, 1)}
    assert got(jaccard_components(make_docs(["a b c", "d e f"]))) == {0: (1, 0), 1: (1, 1)}


def test_repeated_rows_long_text_and_clashing_columns(spark, make_docs):
    long = " ".join(f"x{i}" for i in range(30_000))
    df = make_docs([long, long + " tail", "p q r"], [5, 3, 9])
    df = df.union(df).withColumn("key", df.doc_id).withColumn("n", df.doc_id).withColumn("comp", df.doc_id)
    out = got(jaccard_components(df))
    assert {i: c for i, (_, c) in out.items()} == {5: 3, 3: 3, 9: 9}


def test_near_copies_repeated_over_partitions(spark, make_docs):
    # ten words and the same with one more: the longer text alone lacks one shingle, in some seeds in the counted share
    texts = []
    for seed in range(40):
        words = [f"s{seed}w{i}" for i in range(11)]
        texts += [" ".join(words[:10]), " ".join(words)]
    want = brute(list(enumerate(texts)), 4, 85, 100)
    assert all(want[2 * i + 1][1] == 2 * i for i in range(40))
    once = make_docs(texts).coalesce(1)
    for copies in (1, 2, 5):
        table = once
        for _ in range(copies - 1):
            table = table.union(once)
        assert got(jaccard_components(table, 4, 85, 100)) == want
    # rows of one text under other ids and long ids are counted in several partitions as well
    big = 2**60 + 1
    table = once.union(make_docs(texts, [big + i for i in range(len(texts))]).coalesce(1))
    both = {**want, **{big + i: (n, c) for i, (n, c) in want.items()}}
    assert got(jaccard_components(table, 4, 85, 100)) == both


def test_rows_of_one_id_with_different_texts_fold_to_one(spark, make_docs):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(30))
    found = set()
    for flip in (False, True):
        rows = [(1, a), (1, b), (2, a), (3, b)]
        table = make_docs([t for _, t in rows], [i for i, _ in rows])
        found.add(tuple(sorted(got(jaccard_components(table.orderBy("n_chars", ascending=flip).coalesce(1), 4, 85, 100)).items())))
    assert len(found) == 1 and dict(next(iter(found))) in (
        {1: (17, 1), 2: (17, 1), 3: (27, 3)},
        {1: (27, 1), 2: (17, 2), 3: (27, 1)},
    )


def test_given_table_against_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = duckdb.connect().execute(f"select doc_id, text from '{sf001}/documents.parquet'").fetchall()
    assert got(jaccard_components(docs, 4, 85, 100)) == brute(rows, 4, 85, 100)
