"""Edge cases and brute-force comparisons of the corpus operators other than the Jaccard join."""

import base64
import gzip
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablier.llm import annforest, chat, chunkbpe, decontaminate, pii, quality, tokenbits, toxicity, warc
from tablier.llm.queries import tokenizer_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
LONG = " ".join(f"w{i % 977}é, x+{i}" for i in range(20_000))
TEXTS = [None, "", " ", "A b c.", "A b c.", LONG, "<|endoftext|> a<|startoftext|>", "日本語 ﬁ don't DON'T 12.5\n\n  x", "\x1c\x85 b", "🙂" * 300]


def clash(df):
    """Extra columns named like the operators' own."""
    for c in ("score", "n", "h", "key", "width", "shard", "ids", "x", "y", "part", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


# ---------------------------------------------------------------- 1


def brute_contained(docs, items, width=5):
    cut = lambda t, w: {tuple(x[i : i + w]) for x in [(t or "").lower().split()] for i in range(len(x) - w + 1)}
    out = set()
    for j, item in items:
        w = min(width, len((item or "").split()))
        need = cut(item, w) if w else set()
        for i, text in docs:
            found = len(need & cut(text, w)) if need else 0
            if need and found * 10 >= len(need) * 8:
                out.add((i, j, len(need), found))
    return out


def test_decontamination_against_brute_force(spark, make_docs):
    rng = random.Random(1)
    words = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    items = [(0, words(40)), (1, words(15)), (2, "one two"), (3, None), (4, ""), (5, words(130)), (6, "solo"), (7, words(15))]
    items.append((8, items[0][1]))
    docs = []
    for _ in range(60):
        body = words(rng.randrange(0, 400)).split()
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(0, 3)):
            if item:
                item[rng.randrange(len(item))] = "zz"
        at = rng.randrange(len(body) + 1)
        docs.append(" ".join(body[:at] + item + body[at:]))
    docs += [None, "", "ONE  two", LONG + " " + items[5][1]]
    table = clash(make_docs(docs)).union(clash(make_docs(docs[:3])))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("n", F.lit(1))
    got = {tuple(r) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == brute_contained(list(enumerate(docs)), items)
    empty = bench.where("false")
    assert decontaminate.contaminated(table, empty).count() == 0
    assert decontaminate.contaminated(table.where("false"), bench).count() == 0


def test_decontamination_of_repeated_rows_and_ids(spark, make_docs):
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([6, 9, 14, 20, 33, 60, 90, 140])]
    docs = [" ".join(words(50) + t.split()[k:] + words(30)) for _, t in items for k in (0, 1, 2, 3)]
    once = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    table = make_docs(docs)
    want = brute_contained(list(enumerate(docs)), items)
    assert len(want) > 16
    assert {tuple(r) for r in decontaminate.contaminated(table, once(items)).collect()} == want
    again = decontaminate.contaminated(table.union(table).union(table), once(items * 4)).collect()
    assert len(again) == len(want) and {tuple(r) for r in again} == want
    # halves of an item in two rows of one id are no match, and the best of an id's rows counts
    half = items[4][1].split()
    rows = [" ".join(half[:18]), " ".join(half[14:]), items[4][1], " ".join(half[1:])]
    got = decontaminate.contaminated(make_docs(rows, [1, 1, 2, 2]), once(items)).collect()
    assert [tuple(r) for r in got] == [(2, 4, 29, 29)]
    # one id with two texts is searched for both
    got = decontaminate.contaminated(make_docs([items[3][1], items[5][1]]), once([(7, items[3][1]), (7, items[5][1])])).collect()
    assert {tuple(r) for r in got} == {(0, 7, 16, 16), (1, 7, 56, 56)}


# ---------------------------------------------------------------- 3


def test_warc_derivatives(spark):
    page = "<html><head><title>A &amp; B</title><script>no()</script></head><body><p>One <b>two</b>&nbsp;three<br>four<!-- x --><a href='u'>l</a>"
    rows = [(1, "http://a/ü", page), (2, None, None), (3, "http://c", ""), (3, "http://c", ""), (None, "u", "x"), (4, "http://d", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    source = {r.page_id: bytes(r.record) for r in warc.responses(pages).collect()}
    made = warc.gzip_members(warc.derivatives(warc.responses(pages))).collect()
    assert len(made) == 10
    for r in made:
        head, block = warc.parse(bytes(r.record))
        origin, _ = warc.parse(source[r.page_id])
        assert head["WARC-Refers-To"] == origin["WARC-Record-ID"] == r.refers_to
        assert head["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert gzip.decompress(r.member) == bytes(r.record)
    one = {r.warc_type: r.text for r in made if r.page_id == 1}
    assert one["conversion"] == "One two three\nfour l"
    assert "title: A & B" in one["metadata"] and "http-header: Content-Type: text/html" in one["metadata"] and "outlinks: 1" in one["metadata"]
    assert {r.text for r in made if r.page_id in (2, 3) and r.warc_type == "conversion"} == {""}
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


def test_warc_text_title_and_links_against_plain_patterns(spark, sf001):
    drop = re.compile(r"<!--.*?-->|<(script|style|noscript|template|head)\b[^>]*>.*?</\1\s*>|<!--.*|<(?:script|style)\b.*", re.S | re.I)
    blocks = re.compile(r"</?(?:p|h[1-6]|div|ul|ol|li|nav|article|footer|br|main|section|header|table|tr|td|th)\b[^>]*>", re.I)
    pages = [r.html for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()]
    pages += ["<template>a</template>b<template>c", "a<!-- x -->b<!-- c", "<SCRIPT>x</script >y<style>z", "<head>t</head>u<title>v</title>", "", "x"]
    for page in pages:
        text = html.unescape(re.sub(r"<[a-zA-Z/!?][^>]*>", "", blocks.sub("\n", drop.sub(" ", page))))
        want = "\n".join(x for x in (" ".join(line.replace("\xa0", " ").split(" ")).strip() for line in text.split("\n")) if x)
        assert re.sub(" +", " ", warc.plain_text(page)) == re.sub(" +", " ", want)
        assert warc.links_in(page) == len(re.findall(r"<a\b[^>]*?\bhref\s*=", page, re.I))
        title = re.search(r"<title\b[^>]*>(.*?)</title\s*>", page, re.S | re.I)
        assert warc.title_of(page) == (title.group(1) if title else None)


@pytest.mark.parametrize("part", ["<template>", "<title>", "<a ", "<!--", "<script", "<head", "</p", "<a href", "<noscript>x</noscript"])
def test_warc_of_broken_markup_takes_linear_time(part):
    before = time.process_time()
    page = part * (1_000_000 // len(part))
    warc.plain_text(page), warc.links_in(page), warc.title_of(page)
    assert time.process_time() - before < 5


# ---------------------------------------------------------------- 4


def test_forest_recall_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)) + rng.normal(size=(6, 16))[rng.integers(0, 6, 900)] * 2
    x[200:500] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(950, None), (1000, [0.0] * 16), (1050, [float("nan")] * 16), (1100, [1.0, None] * 8), (1150, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(1))
    got = {}
    for r in annforest.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 900, 50))
    norm = np.linalg.norm(x, axis=1)
    hit = 0
    for q, found in got.items():
        s = x @ x[q] / (norm * norm[q])
        best = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:5]
        hit += len({v for v, _ in found.values()} & set(best))
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - sc) < 1e-12 for v, sc in found.values())
    assert hit >= 0.9 * 5 * len(got)
    assert [got[0][k][0] for k in range(1, 6)] == [200, 201, 202, 203, 204]
    assert annforest.nearest(df.where("false")).count() == 0
    assert annforest.nearest(df.where("vec_id in (0, 3)")).count() == 1


# ---------------------------------------------------------------- 5


def base_by_plain_regex(text):
    out = {k: [] for k in pii.KINDS}
    for kind, rx in zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)):
        for m in rx.finditer(text or ""):
            d = [c for c in m.group() if c.isdigit()]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                  "card": 16 <= len(d) <= 19 and pii.luhn("".join(d)), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, make_docs):
    texts = TEXTS + [
        "mail a.b@c.example.com, ü@x.y and @ b@c c@d.e@f.g", "ip 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8",
        "card 4111 1111 1111 1111 5500-0000-0000-0004 x", "card 4111111111111111", "card 4111111111111112", "call +1 (017) 555-7713 now",
        "call +12 345 678 901 222 333 444 555", "clean text without any",
    ]
    rng = random.Random(3)
    for _ in range(200):
        texts.append("x " + "".join(rng.choice("0123456789") for _ in range(16)) + f" y +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} z")
    out = {r.doc_id: r for r in pii.personal_data(clash(make_docs(texts))).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        base = base_by_plain_regex(t)
        r = out[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.KINDS]
        joined = ",".join(x for k in pii.KINDS for x in base[k])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert out[len(TEXTS) + 7].spans == "" and out[0].spans == ""
    red = {r.doc_id: r for r in pii.redact(make_docs(texts)).collect()}
    assert red[0].text is None and red[len(TEXTS) + 3].text == "card <CARD>" and red[len(TEXTS) + 3].n_chars == 11
    assert pii.personal_data(make_docs([])).count() == 0


def test_email_candidates_are_bounded_and_need_negatives(spark, make_docs):
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    local = lambda: ".".join(name() for _ in range(rng.randrange(1, 4)))
    mail = lambda: f"{local()}@{local()}.{rng.choice(['com', 'de', 'org', 'co.uk'])}"
    texts = [f"mail {mail()} now or {mail()}, see {name()} @{name()} and {local()}@{name()}{name()} soon" for _ in range(400)]
    odd = ["hello @name there", "see a@b now", "日本語の文章" * 200 + "@" + "続きの文章" * 200, "x" * 5000 + "@" + "y" * 5000, "f(x)=a@b;g(y)" * 400]
    right = ["mail jürgen.groß@bücher.de now", "mail rené@example.com, please"]
    docs = make_docs(texts + odd + right)
    model = pii.fit(docs)
    out = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    base = {i: ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_and_runs(t)[0]) for i, t in enumerate(texts + odd)}
    assert {i: out[i] for i in base} == base
    assert [out[len(base)], out[len(base) + 1]] == ["email:5:26", "email:5:21"]
    assert 0.5 <= model.thresholds["email"] <= 1 and model.thresholds["ip"] == 2
    for t in ("a@" * 300_000, "é" * 300_000 + "@", "a" * 300_000 + "@b.c", "'" * 300_000 + "@" + "-" * 300_000):
        assert all(b - a <= 320 for _, a, b in pii.addresses(t))
    one_class = pii.Trees().fit(np.array([[0.0, 1.0], [1.0, 0.0]] * 20), np.array([1.0, 0.0] * 20))
    one_class.calibrate(np.array([[0.0, 1.0]] * 9), np.ones(9), np.zeros(9))
    assert one_class.thresholds["email"] == 2


PLANTED = {
    "phone": ["call (030) 1234567 now", "tel 555-123-4567 please", "ring 0171 2345678 today"],
    "card": ["my card 4111.1111.1111.1111 here", "a card 3782 822463 10005 here"],
    "ip": ["host 192[.]168[.]1[.]77 down", "server 10 . 20 . 30 . 40 down"],
    "email": ["write bob[at]example.com now", "write bob [at] example [dot] com now", "mail rené@example.com, please"],
}
OTHER = ["in 2024-01-15 we had 1234567 and 12.05.2021 of 1.234.567 at 12345678", "number 1234567890123456 x", "card 4111.1111.1111.1112 here", "a@b [at] c"]


def test_trees_add_planted_spans_of_each_kind(spark, make_docs, monkeypatch):
    corpus = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text RLIKE '[0-9@]'").select("text").collect()]
    planted = [(k, t) for k, texts in PLANTED.items() for t in texts]
    docs = make_docs([t for _, t in planted] + OTHER + corpus)
    found = {r.doc_id: r for r in pii.personal_data(docs).where(f"doc_id < {len(planted) + len(OTHER)}").collect()}
    for i, (kind, text) in enumerate(planted):
        r = found[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [0, 0, 0, 0]
        assert [x.split(":")[0] for x in r.spans.split(",")] == [kind], text
    assert [found[len(planted) + i].spans for i in range(len(OTHER))] == [""] * len(OTHER)
    monkeypatch.setattr(pii, "fit", lambda docs: None)  # without the trees nothing is added
    assert {r.spans for r in pii.personal_data(make_docs([t for _, t in planted])).collect()} == {""}


def test_one_long_document_does_not_fill_the_fitting_sample(spark, make_docs, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 400)
    ids = [i for i in range(800) if i % 4]
    first = spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id")).first().doc_id
    texts = ["mail a%d@x%d.example.com and a%d@b now" % (i, i, i) for i in ids]
    texts[ids.index(first)] = " ".join("u%d@host%d.org" % (i, i % 50) for i in range(1500))
    model = pii.fit(make_docs(texts, ids))
    assert model.thresholds["email"] <= 1


def test_base_spans_of_long_runs_and_random_marks():
    rng = random.Random(5)
    texts = ["".join(rng.choice("a1.@-+ %\n") for _ in range(60)) for _ in range(400)]
    texts += ["".join(rng.choice("123.") for _ in range(40)) for _ in range(400)]
    for t in texts:
        base = [f"{k}:{a}:{b}" for k, a, b in pii.base_and_runs(t)[0]]
        assert base == [x for k in pii.KINDS for x in base_by_plain_regex(t)[k]]
    n = 300_000
    for t in ("a" * n + "@", "1" * n, "@" * n, "1." * n, "a@" * n, "+" * n, "x" * n + " a@b.c"):
        assert pii.find(t, None)[0] == ([("email", n + 1, n + 6)] if t.endswith("c") else pii.base_and_runs(t)[0])


def test_filters_pass_other_columns_unchanged(spark, make_docs):
    big = 2**53 + 1
    docs = make_docs(["x a@b.co", None, "", "fine"]).withColumn("big", F.when(F.col("doc_id") != 1, F.lit(big)))
    docs = docs.withColumn("tags", F.array(F.lit("t"), F.lit(None)))
    labels = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic long")
    for out in (pii.redact(docs), toxicity.keep_clean(docs, labels)):
        rows = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and [rows[i].big for i in range(4)] == [big, None, big, big]
        assert rows[1].text is None and rows[3].tags == ["t", None]


def test_boosted_trees_separate_and_calibrate():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 4, 800), rng.normal(size=(800, 3))])
    y = ((x[:, 1] > 0) & (x[:, 2] > 0.2)).astype(float)
    model = pii.Trees().fit(x[:600], y[:600])
    assert ((model.scores(x[600:]) > 0.5) == y[600:]).mean() > 0.95
    model.calibrate(x[600:], y[600:], x[600:, 0])
    assert all(0.5 <= t <= 2 for t in model.thresholds.values())


# ---------------------------------------------------------------- 6, 8


def labelled(spark, sf001):
    big = sf001.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")


@pytest.mark.parametrize("op,column,least", [(quality.quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.95)])
def test_held_out_accuracy_and_label_use(spark, sf001, op, column, least):
    docs, labels = labelled(spark, sf001)
    docs = docs.where("doc_id < 6000")
    rows = op(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held[column]).mean() > least
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(rows.doc_id, rows.held_out))


@pytest.mark.parametrize("op,column", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifier_edge_cases(spark, make_docs, op, column):
    docs = clash(make_docs(TEXTS + ["bad fool here %d" % i for i in range(30)] + ["fine words here %d" % i for i in range(30)]))
    rows = [(i, 1 if 10 <= i < 40 else 0) for i in range(70)] + [(None, 1), (3, None), (3, 0)]
    labels = spark.createDataFrame(rows, f"doc_id long, {column} long").withColumn("text", F.lit("clash"))
    for lab in (labels, labels.where("false")):
        out = op(docs, lab).collect()
        assert len(out) == 70 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert op(docs.where("false"), labels).count() == 0


def test_nnpu_risk_finds_positives():
    rng = np.random.default_rng(1)
    xp = (rng.random((400, 12)) < np.array([0.7] * 3 + [0.2] * 9)).astype(np.float32)
    xn = (rng.random((2000, 12)) < np.array([0.02] * 3 + [0.2] * 9)).astype(np.float32)
    xu = np.concatenate([xn, (rng.random((300, 12)) < np.array([0.7] * 3 + [0.2] * 9)).astype(np.float32)])
    w, b = toxicity.fit_nnpu(xp, xu, 300 / 2300)
    # two or three of the telling features make a text toxic at this prior: 0.784 of the positives
    assert ((xp @ w + b) > 0).mean() > 0.75 and ((xn @ w + b) > 0).mean() < 0.1


# ---------------------------------------------------------------- 7, 9


@pytest.mark.parametrize("bits", [1, 7, 11, 16, 17, 31, 32])
def test_bit_packing_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    data = tokenbits.pack_ids(ids, bits)
    assert len(data) == (1000 * bits + 7) // 8
    assert (tokenbits.unpack_ids(data, bits, 0, 1000) == ids).all()
    assert (tokenbits.unpack_ids(data, bits, 333, 100) == ids[333:433]).all()


def test_token_files(spark, make_docs):
    ids = [7, 3, 3, 11, 2, 90, -5, 1, 0, 8]
    docs = clash(make_docs(TEXTS + ["x"], ids + [None]))
    got = [tuple(r) for r in tokenbits.token_table(docs, tokenizer_path(WORD)).orderBy("start").collect()]
    enc, start, want = tokenizer(WORD), 0, []
    for i, t in sorted(zip(ids, TEXTS), key=lambda x: (x[0], x[1] or "")):
        x = np.array(enc.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert tokenbits.token_table(docs.where("false"), tokenizer_path(WORD)).count() == 0


def test_chunk_bpe_equals_the_library(spark, make_docs, sf001):
    docs = clash(make_docs(TEXTS))
    enc = tokenizer(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chunkbpe.round_trip(docs, tokenizer_path(BYTE)).collect():
        ids = enc.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(enc.decode(ids, skip_special_tokens=False))
    back = chunkbpe.decode_documents(chunkbpe.encode_documents(docs, tokenizer_path(BYTE)), tokenizer_path(BYTE)).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert chunkbpe.round_trip(docs.where("false"), tokenizer_path(BYTE)).count() == 0


@pytest.mark.parametrize("mean", [16, 64])
def test_short_chunks_are_repaired(spark, sf001, mean):
    codec = chunkbpe.ChunkCodec(tokenizer_path(BYTE), mean)
    enc = tokenizer(BYTE)
    texts = [r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").limit(60).collect()]
    texts += ["aaaa" * 200, "a  b   c \n\n d " * 50, "é ü " * 100, "don't we'll " * 60, LONG[:5000], " " * 700]
    for t in texts + [x[::-1] for x in texts]:
        assert codec.encode(t).tolist() == enc.encode(t, add_special_tokens=False).ids
    assert codec.reused > 0


# ---------------------------------------------------------------- 10


def test_chat_round_trip_and_layouts(spark):
    texts = [None, "", "\\", "###", "\\### x", "</turn>", "a\n### Assistant: </turn>", LONG, "### User: x</turn>\n"]
    rows = [(i % 4, i // 4, ["user", "assistant", None, "System: x\n"][i % 4], t) for i, t in enumerate(texts * 3)]
    rows += [(0, 0, "user", "tie"), (0, 0, "user", "tie"), (0, None, "assistant", "late"), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert set(got) == {0, 1, 2, 3}
    for c, r in got.items():
        turns = [(t, ro or "user", x or "") for cc, t, ro, x in rows if cc == c]
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        want = "".join(f"{ro}\n{x}\n" for _, ro, x in turns)
        loss = "".join(x for _, ro, x in turns if ro == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(chat.canonical_turns(df.where("false")))).count() == 0

    messages = spark.sql("SELECT 1L conv_id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) conversations")
    pair = spark.sql("SELECT 1L conv_id, 'q' prompt, 'a' response")
    task = spark.sql("SELECT 1L conv_id, 's' instruction, 'q' input, 'a' output")
    turns = lambda d: [(r.role, r.text) for r in chat.canonical_turns(d).orderBy("turn").collect()]
    assert turns(messages) == turns(pair) == [("user", "q"), ("assistant", "a")]
    assert turns(task) == [("system", "s"), ("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.sql("SELECT 1L conv_id, 2 other"))
