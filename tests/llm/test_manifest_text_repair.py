"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tablier.llm import convrepair, mainhtml, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TALK = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clash(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---------------------------------------------------------------- 11


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def proofs_of(nodes):
    """(top digest, sibling runs per node): each run is (left, right) from the bottom up."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[i].append((run[: at % 8], run[at % 8 + 1 :]))
            where[i] = at // 8
        level = [sha("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
    return level[0], paths


def brute_manifest(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for g in langs}
    trees = {g: proofs_of([leaf_of(*r) for r in parts[g]]) for g in langs}
    root, tops = proofs_of([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for r, path in zip(parts[g], trees[g][1]):
            whole, leaf = path + top, leaf_of(*r)
            acc = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                acc = leaf_of(r[0], r[1].translate(lower), *r[2:])
            for left, right in whole:
                acc = sha("".join([*left, acc, *right]))
            siblings = "".join("".join(left + right) for left, right in whole)
            out.append((r[0], leaf, trees[g][0], root, sha(siblings), acc, acc == root))
    return sorted(out, key=repr)


def docs_rows(n, langs, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Abc É", "x", "", None, "plain"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 7])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        docs_rows(1, ["en"]),
        docs_rows(9, ["en"]),
        docs_rows(65, ["en"]),
        docs_rows(150, ["en", "en", "en", None, "", "é", "z"]),
        docs_rows(12, [str(i) for i in range(40)]),
        [(None, "A", None, None, None)] * 3 + [(5, "B", "en", "s", 1)] * 9 + [(5, "b", "en", "s", 1), (6, "Q" * 30000, "en", None, 2)],
    ],
    ids=["one", "nine", "two-levels", "languages", "many-languages", "nulls-repeats-long"],
)
def test_manifest_against_brute_force(spark, rows):
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(3), "leaf", "rank", "g", "n", "at", "path")
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)
    assert got == brute_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    made = merkle.manifest(spark.createDataFrame([], DOCS))
    assert made.count() == 0 and made.columns == [c.split()[0] for c in merkle.RESULT.split(", ")]


def test_manifest_finds_exactly_the_changed_texts(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in merkle.manifest(docs).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and re.search("[A-Z]", texts[r.doc_id] or "")
        assert r.verified == (not changed)


# ---------------------------------------------------------------- 12

SENTENCE = "The quick brown fox, as they say, jumps over the lazy dog; nobody was surprised. "
PARAGRAPHS = [SENTENCE * 3, SENTENCE * 2 + "Second one.", SENTENCE * 4, "Short.", SENTENCE]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n".join(p.strip() for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(8)) + "</ul>"
PAGES = {
    "unmarked containers": (
        f'<html><body><div id="top">{MENU}</div><div id="content"><h1>Title</h1>{BODY}</div><div id="bottom">Copyright 2020 Foo Inc. All rights reserved.</div>',
        "Title\n" + WANT,
    ),
    "sidebar and notice": (
        f'<nav>{MENU}</nav><div class="layout"><div class="sidebar"><p>{SENTENCE}</p></div><div class="content"><h1>T</h1>{BODY}</div></div>'
        '<div class="cookie-notice">We use cookies. <button>OK</button></div><footer>f</footer>',
        "T\n" + WANT,
    ),
    "reader comments": (
        f'<main><article><h1>T</h1>{BODY}<ul><li>First item</li><li>Second item</li></ul><blockquote>Quote.</blockquote></article>'
        f'<section id="comments"><h2>Comments</h2><div class="comment"><p>{SENTENCE * 5}</p></div><p>{SENTENCE * 9}</p></section></main>',
        "T\n" + WANT + "\nFirst item\nSecond item\nQuote.",
    ),
    "comments within": (f'<article><h1>T</h1>{BODY}<div class="comments"><article><p>{SENTENCE * 20}</p></article></div></article>', "T\n" + WANT),
    "aside and form within": (f"<article><h1>T</h1>{BODY}<aside>Buy this.</aside><form><label>Email</label><input><button>Go</button></form></article>", "T\n" + WANT),
    "table layout": (f"<table><tr><td>{MENU}</td><td><h1>T</h1>{BODY}</td><td><b>Links</b><br><a href=x>one</a><br><a href=y>two</a></td></tr></table>", "T\n" + WANT),
    "form around the page": (f'<form id="f"><div class="header">Site</div><div class="content"><h1>T</h1>{BODY}</div></form>', "T\n" + WANT),
    "layout words": (f'<body class="has-sidebar"><div class="with-sidebar"><div class="sidebar-right">{MENU}</div><div class="post"><h1>T</h1>{BODY}</div></div>', "T\n" + WANT),
    "heading before the article": (f"<main><h1>T</h1><article>{BODY}</article></main>", "T\n" + WANT),
    "header of the article": (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header>{BODY}<footer>Share</footer></article>", "T\n" + WANT),
    "two parts": (f"<div id=c><div class=intro><p>{SENTENCE}</p></div><div class=rest>{BODY}</div></div>", SENTENCE.strip() + "\n" + WANT),
    "a paragraph that is a link": (f"<article>{BODY}<p><a href=x>{SENTENCE}</a></p></article>", WANT + "\n" + SENTENCE.strip()),
    "a list of links": (f"<article>{BODY}<ul class=x><li><a href=1>Some other story</a><li><a href=2>Another one</a></ul></article>", WANT),
    "teaser": (f"<main><article><h1>T</h1>{BODY}</article><article><h3><a href=x>Teaser</a></h3><p>Short teaser.</p></article></main>", "T\n" + WANT),
    "one word": ('<nav><a href=x>A long home page</a></nav><div class="ad">Buy this now, it is great. Really.</div><article><p>Hi</p></article>', "Hi"),
    "references": ("<article><p>a &lt;b&gt; &amp;amp; &#233;&#x1F600;&nbsp;x &copy y</p></article>", "a <b> &amp; é😀 x © y"),
    "inline advert": ('<article><p>foo<b>bar</b> <i>x</i>y<span class="ad">Buy</span> z</p></article>', "foobar xy z"),
    "bare signs": ("<article><p>1 < 2 and 3 > 2 <3</p></article>", "1 < 2 and 3 > 2 <3"),
    "quotes": ("<article><p title=\"a > b\">x</p><p title=it's>don't</p></article>", "x\ndon't"),
    "script and style": ('<article><p>x</p><script>if(a<b){w("<p>no</p>")}</script><style>p{}</style><p>y</p></article>', "x\ny"),
    "script without end": ("<article><p>x</p><script>if(a<b)", "x"),
    "comment without end": ("<article><p>x</p><!-- hi <p>y", "x"),
    "implied ends": ("<article><ul><li>a<ul><li>b<li>c</ul><li>d</ul><p><b>e<br><p>f</article>", "a\nb\nc\nd\ne\nf"),
    "white space": ("<ARTICLE><PRE>a\n   b\t c</PRE></ARTICLE>", "a b c"),
    "no markup": ("just text", "just text"),
    "nothing": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_layouts(name):
    source, want = PAGES[name]
    assert mainhtml.main_text(source) == want


def test_paths_below_the_threshold_are_not_selected():
    page = mainhtml.blocks_of(PAGES["unmarked containers"][0])
    blocks = [b.without(page.noise()) for b in page.blocks]
    ratios = mainhtml.path_ratios(blocks)
    by_tag = {b.tag: ratios[b.path] for b in blocks}
    assert by_tag["p"] > 5 * by_tag["div"] > 5 * by_tag["li"]


BROKEN = {
    "div": "<div>" * 60000,
    "tag": "<a " * 100000,
    "quote": '<a href="' * 100000,
    "template": "<template>" * 60000,
    "title": "<title>" * 60000,
    "comment": "<!--" * 100000,
    "list": "<ul><li>x" * 30000,
    "table": "<table><tr><td>x" * 20000,
    "end tags": "<div>" * 30000 + "</section>" * 60000,
    "zones": "<div class=ad>" * 20000 + "<h1>x</h1>" * 20000,
    "signs": "&am<" * 100000,
    "attributes": "<p " + "class " * 100000 + ">x",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_markup_takes_linear_time(name):
    before = time.process_time()
    mainhtml.main_text(BROKEN[name])
    assert time.process_time() - before < 5


def brute_article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    parts = re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_main_text_of_the_given_pages(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    want = {r.page_id: brute_article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in mainhtml.extract(clash(pages, "text", "n_chars", "zone")).collect()}
    assert got == want


def test_extract_edge_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (2, "u", "<p>é😀</p>"), (2, "u", "<p>é😀</p>"), (3, "", "<p>" + "long word, " * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url, r.text if r.n_chars < 100 else len(r.text), r.n_chars) for r in mainhtml.extract(pages).collect()}
    long = len(("long word, " * 50000).strip())
    assert got == {(1, None, "", 0), (None, "u", "x", 1), (2, "u", "é😀", 2), (3, "", long, long)}
    assert mainhtml.extract(pages).count() == 5 and mainhtml.extract(pages.where("false")).count() == 0


# ---------------------------------------------------------------- 13


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def marks(kept):
    """(role, text, must go, truncated) and the counts of a conversation."""
    seen, out = set(), []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in kept:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    return out, counts


def all_edits(rows):
    """(cost, audit, lines) of the cheapest of all edit sequences with at most two insertions in a row."""
    gaps = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    best = None
    for gap in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for i, inserted in enumerate(gap):
                cost, audit = cost + 2 * len(inserted), audit + "I" * len(inserted)
                lines += [(name, "") for name in inserted]
                if i < len(rows):
                    role, text, gone, cut = rows[i]
                    if edits[i] == "D":
                        cost, audit = cost + 3, audit + "D"
                        continue
                    if gone:
                        break
                    new = role if edits[i] == "K" else {"u": "user", "a": "assistant"}[edits[i]]
                    cost, audit = cost + (0 if edits[i] == "K" else 2) + cut, audit + ("K" if edits[i] == "K" else "R")
                    lines.append((new, text))
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best


def by_strings(rows):
    """The same by a table of (cost, audit, lines) tuples, for long conversations."""
    best = {"": (0, "", ())}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def gap(table):
        for _ in range(2):
            new = dict(table)
            for s, (c, a, t) in table.items():
                to = follow[s]
                new[to] = min(new.get(to, (10**9,)), (c + 2, a + "I", (t, (names[to], ""))))
            table = new
        return table

    for role, text, gone, cut in rows:
        new = {}
        for s, (c, a, t) in gap(best).items():
            options = [(s, (c + 3, a + "D", t))]
            if not gone:
                to = follow[s]
                options += [("s", (c + cut, a + "K", (t, (role, text))))] if s == "" and role[:1] == "s" else []
                fits = role[:1] == to
                options.append((to, (c + cut + (0 if fits else 2), a + ("K" if fits else "R"), (t, (role if fits else names[to], text)))))
            for to, o in options:
                new[to] = min(new.get(to, (10**9,)), o, key=lambda x: x[:2])
        best = new
    cost, audit, lines = min((v for s, v in gap(best).items() if s in ("", "a")), key=lambda x: x[:2])
    flat = []
    while lines:
        lines, last = lines
        flat.append(last)
    return cost, audit, flat[::-1]


def searched(rows):
    talk = convrepair.Repair()
    for r in rows:
        talk.feed(*r)
    return talk.finish()


def digest(lines):
    return sha("\n".join(f"{r}:{t}" for r, t in lines))


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", " ", "", "tool"]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]


def test_search_against_all_edit_sequences():
    rng = random.Random(8)
    for n in (0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2):
        rows = random_rows(rng, n)
        cost, audit, lines = all_edits(rows)
        assert searched(rows) == (cost, audit, digest(lines)), rows
        assert by_strings(rows)[:2] == (cost, audit)


def test_search_over_several_blocks():
    rng = random.Random(9)
    for n in (3, 4, 5, 6, 8, 13, 255, 256, 257, 512, 1500):
        rows = random_rows(rng, n)
        cost, audit, lines = by_strings(rows)
        assert searched(rows) == (cost, audit, digest(lines))


def test_repair_of_tables(spark):
    rng = random.Random(10)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(0, 9)):
            t = None if rng.random() < 0.1 else turn + (3 if rng.random() < 0.1 else 0)
            text = rng.choice([None, "", " \t", "Hi.", "Hi.", "No end", "Ends! \n", "é?", "a.b", "x" * 5000 + "."])
            rows.append((conv, t, rng.choice(["user", "assistant", "system", None, "tool"]), text))
    rows += rows[:25]
    table = clash(spark.createDataFrame(rows, TALK).repartition(4), "code", "alive", "digest", "later", "conv_key")
    got = {r.conv_id: tuple(r)[1:] for r in convrepair.repair(table).collect()}
    want = {}
    for conv, kept in brute_damage(rows).items():
        marked, counts = marks(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for r, _, _, _ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = by_strings(marked)
        want[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest(lines))
    assert got == want
    assert convrepair.repair(table.where("false")).count() == 0


def test_conversation_that_is_dropped_whole(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = convrepair.repair(spark.createDataFrame([(conv, 0, "user", "Hi.")], TALK)).first()
    assert tuple(got) == (conv, 0, 0, 0, 0, 0, 0, "", sha(""))
