"""Operator 5: personal data by boosted trees over overlapping candidate spans.

*Base rules* (email, ip, card, phone; the patterns and checks below are fixed
values) always count. *Generators* propose more candidates with high recall:
windows of whole number groups in every digit field (digits with up to two
separators between them, a ``+`` or not), as phone from 7 digits, as card from
13, as ip where four groups are parted by dots, brackets or blanks (so inside
runs that failed their check too); and the address characters around an @ or a
written ``[at]`` (Latin letters with accents too, at most 64 before and 253
after it). Format and context features go to gradient-boosted trees, written in numpy.

The trees do not learn from the base checks that they are to go beyond.
Positives are the base spans and *variants* of them in their own context, which
lost the mark that the base rule needs: phones without ``+`` or country code or
with other separators, cards with dots, slashes or 13 to 15 digits, ips with
bracketed or spaced dots, addresses with ``[at]`` and
``[dot]``. Negatives are candidates that touch no base span (other numbers of
the corpus), windows that cut a base span or take it for another kind, variants
with a wrong check digit or part, and dates, amounts and plain numbers written
in place of base spans. The other numbers of the corpus may hold what the trees
are to find: those that trees fitted without them are sure of (``SURE``) are left
out of the fit, unless they are more than ``DOUBT`` of their kind's, which then is
a common format and no personal data. The trees are fitted on a bounded sample (``SAMPLE``
candidates in the order of a hash of document and offset, so no document fills
it alone). A per-kind threshold is calibrated on a held-back part so that
accepted candidates keep ``PRECISION``; without both classes of the kind in that
part nothing of it is added. Accepted candidates that touch no base span and no
better candidate are added; equal scores go to the smaller start, then to the
longer span, then to the kind listed first.

Null and empty texts have no spans: counts 0, the digest of the empty string,
empty ``spans``. Offsets are code points, end exclusive. Repeated rows are kept.
Extra columns are not read. A text is scanned whole by one task.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, returning_memory, text_or_empty

# Kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same matches in linear time: a digit run is entered at its start alone, an address at its @.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")

_GROUP = re.compile(r"[0-9]+")
# Internet addresses with accented letters: EMAIL has the ASCII ones alone. A candidate is as long as an address can be.
_ALNUM = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ATOM = _ALNUM + r"!#$%&'*+/=?^_`{|}~\-"
_LABEL = f"[{_ALNUM}]++(?:-++[{_ALNUM}]++)*+"
_ADDRESS = re.compile(rf"[{_ATOM}]++(?:\.[{_ATOM}]++)*+@(?:{_LABEL}\.)++(?:[^\W\d_]{{2,}}+|xn--[A-Za-z0-9-]++)")
_BEFORE_AT, _AFTER_AT = re.compile(rf"[{_ATOM}.]*\Z"), re.compile(rf"[{_ALNUM}.-]*")
LOCAL_CHARS, HOST_CHARS = 64, 253
# Digits with up to two separators between them, dots perhaps in brackets; linear, entered at its first digit alone.
_FIELD = re.compile(r"(?<![0-9])[0-9]++(?:(?:[ ().\-/]{1,2}|[\[(]\.[\])]| \. )[0-9]++)*+")
_AT_WORD = re.compile(r" ?[\[(] ?at ?[\])] ?", re.I)
_WORD_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)*+", re.I)
# Shapes of phones and cards, and of numbers that are neither; words that announce a kind.
PHONE_SHAPES = ("(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "(0##) #######", "0## ### ####", "0###/######", "00## ### #######")
CARD_SHAPES = ("################", "####.####.####.####", "####/####/####/####", "####  ####  ####  ####", "#### ###### #####", "####-######-#####",
               "###############", "#### ###### ####", "#############")
OTHER_SHAPES = ("#######", "########", "##########", "####-##-##", "##.##.####", "##/##/####", "#.###.###", "## ### ###", "####.####", "#######.##", "####-####", "##-##-####")
CONTEXT_WORDS = {
    "email": frozenset("mail email contact kontakt correo courriel".split()),
    "ip": frozenset("ip host server address from adresse".split()),
    "card": frozenset("card visa mastercard amex credit carte karte tarjeta".split()),
    "phone": frozenset("phone tel call fax mobile cell telefon téléphone teléfono móvil ruf".split()),
}
#: Candidates that the trees are fitted on, and documents they come from, at most.
SAMPLE, SAMPLE_DOCS = 20_000, 20_000
PRECISION = 0.995
#: Candidates without a label that score so high are set aside while they are at most this share of their kind's.
SURE, DOUBT = 0.8, 0.02
TREES, DEPTH, BINS, RATE = 80, 5, 24, 0.2

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def _ip_ok(s: str) -> bool:
    return all(int(p) <= 255 if len(p) < 400 else not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 for p in s.split("."))


def _emails(text: str) -> list[Span]:
    """Matches of EMAIL: back from every @ over its local part, on over its host; long runs are read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        host = _HOST.match(text, at + 1)
        if host and start < at:
            out.append(("email", start, host.end()))
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_and_runs(text: str) -> tuple[list[Span], list[Span]]:
    """Accepted base spans and the runs whose check failed, by kind and start."""
    base, failed = _emails(text), []
    for kind, pattern, ok in (("ip", _IP_RUNS, _ip_ok), ("card", CARD, _card_ok), ("phone", PHONE, _phone_ok)):
        if kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            (base if ok(m.group()) else failed).append((kind, m.start(), m.end()))
    return base, failed


def _fields(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Digit fields: their text and groups."""
    for m in _FIELD.finditer(text):
        if m.end() - m.start() >= 7:
            yield m.group(), [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m.group())]


def numbers(text: str) -> list[Span]:
    """Windows of whole groups of the digit fields, by the kinds that they could be."""
    out = []
    for field_text, groups in _fields(text):
        dotted = "." in field_text
        for i, (a, _) in enumerate(groups):
            size = 0
            for j in range(i, min(len(groups), i + 8)):
                b = groups[j][1]
                size += b - groups[j][0]
                if size > 19:
                    break
                if dotted and j == i + 3 and max(e - s for s, e in groups[i : j + 1]) <= 3:
                    out.append(("ip", a, b))
                if size >= 13:
                    out.append(("card", a, b))
                if 7 <= size <= 15:
                    start = a - 1 if text[a - 1 : a] in ("+", "(") and a else a
                    out.append(("phone", start, b))
    return out


def generate(text: str, base: list[Span]) -> list[Span]:
    """Overlapping candidates of all generators, without the base spans."""
    taken = set(base)
    return [c for c in dict.fromkeys([*numbers(text), *addresses(text), *written_addresses(text)]) if c not in taken]


def written_addresses(text: str) -> list[Span]:
    """Local part, ``[at]`` and a host with dots or ``[dot]``, as long as an address can be."""
    out = []
    for m in _AT_WORD.finditer(text):
        left = re.search(r"[A-Za-z0-9._%+-]*\Z", text[max(0, m.start() - LOCAL_CHARS) : m.start()]).group()
        right = _WORD_HOST.match(text, m.end(), m.end() + HOST_CHARS)
        if left and right:
            out.append(("email", m.start() - len(left), right.end()))
    return out


def addresses(text: str) -> list[Span]:
    """The address characters around every @ where both sides have the length of an address."""
    out, at = [], text.find("@")
    while at >= 0:
        left = _BEFORE_AT.search(text[max(0, at - LOCAL_CHARS - 1) : at]).group()
        right = _AFTER_AT.match(text, at + 1, at + 2 + HOST_CHARS).group()
        if len(left) <= LOCAL_CHARS and len(right) <= HOST_CHARS:
            left, right = left.lstrip(".'`"), right.rstrip(".-")
            if left and right:
                out.append(("email", at - len(left), at + 1 + len(right)))
        at = text.find("@", at + 1)
    return out


def shifted(text: str, base: list[Span]) -> list[Span]:
    """Wrong windows of base spans: negatives for the trees."""
    out = []
    for kind, a, b in base:
        if kind in ("card", "phone") and b - a > 10:
            out += [(kind, a + 1, b), (kind, a, b - 1)]
        elif kind == "email":
            out += [(kind, a + 1, b)] * (text[a + 1] != "@") + [(kind, a, b - 1)] * (text[b - 2] != ".")
    return out


def _luhn_digit(digits: str) -> str:
    return next(c for c in "0123456789" if luhn(digits + c))


def _shaped(digits: str, shape: str) -> str:
    """``shape`` with each # replaced by the next digit (over again when they run out)."""
    out, i = [], 0
    for c in shape:
        if c == "#":
            c, i = digits[i % len(digits)], i + 1
        out.append(c)
    return "".join(out)


def variants(kind: str, s: str) -> list[tuple[str, str, int]]:
    """(kind, text, label) to stand where a base span stands: what it loses is what the base rule asks for."""
    d = _digits(s) or "1234567890"
    if kind == "phone":
        bare = re.sub(r"^[0-9]{1,3}[ .(-]*\(?", lambda m: "(" if "(" in m.group() else "", s[1:])
        out = [("phone", s[1:], 1)] + [("phone", _shaped(d[::-1], x), 1) for x in PHONE_SHAPES]
        out += [("phone", bare, 1)] if 7 <= len(_digits(bare)) <= 15 else []
        return out + [("phone", _shaped(d, x), 0) for x in OTHER_SHAPES]
    if kind == "card":
        out = []
        for shape in CARD_SHAPES:
            n = shape.count("#")
            body = (d * 2)[: n - 1]
            right = _luhn_digit(body)
            out.append(("card", _shaped(body + right, shape), 1))
            out.append(("card", _shaped(body + str((int(right) + 1 + n % 8) % 10), shape), 0))
        return out + [("card", _shaped(d + "7", x), 0) for x in ("#############", "####-##-## ##:##:##", "## ### ### ### ###")]
    if kind == "ip":
        parts = s.split(".")
        out = [("ip", x.join(parts), 1) for x in ("[.]", "(.)", " . ")]
        wrong = [str(256 + int(p[-3:]) % 700) if i == int(d[-1]) % 4 else p for i, p in enumerate(parts)]
        return out + [("ip", x.join(wrong), 0) for x in (".", "[.]", " . ")] + [("ip", _shaped(d, "##.##.##.##"), 0), ("ip", _shaped(d, "#.#.#.#"), 0)]
    local, _, host = s.rpartition("@")
    out = [("email", local + at + host.replace(".", dot), 1) for at, dot in (("[at]", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "))]
    plain = [re.sub(r"^[.-]+|[.-]+$|(?<=\.)\.+", "", re.sub("[0-9]+", "", part)) for part in (local, host)]
    if plain[0] and "." in plain[1]:
        for accents in (str.maketrans({}), str.maketrans("aeou", "áéöü")):
            out.append(("email", f"{plain[0].translate(accents)}@{plain[1]}", 1))
        out.append(("email", f"{plain[0]}@{plain[1].partition('.')[0]}", 0))
    return out + [("email", f"{local}[at]{host.partition('.')[0]}", 0), ("email", f"{local} (at) {host.partition('.')[0]}", 0)]


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, a, b = span
    s = text[a:b]
    d = _digits(s)
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    left, right = text[max(0, a - 24) : a], text[b : b + 24]
    near = left + right
    parts = [p for p in _GROUP.findall(s)]
    groups = [len(g) for g in parts]
    host = s.rpartition("@")[2]
    marks = "".join(c for c in s if not c.isalnum())
    words = set(re.findall(r"[^\W\d_]+", left.lower()))
    return [
        KINDS.index(kind),
        len(s),
        len(d),
        float(luhn(d)) if d else 0.0,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        s.count(" "),
        s.count("-"),
        s.count("."),
        s.count("/"),
        s.count("(") + s.count(")"),
        s.count("["),
        len(set(marks)),
        float(s.startswith("+")),
        float(s.startswith("(")),
        max((int(p[:6]) for p in parts), default=-1),
        sum(len(p) > 1 and p[0] == "0" for p in parts),
        float(len(parts) == 4 and all(int(p[:6]) <= 255 for p in parts)),
        float(bool(_ADDRESS.fullmatch(s))),
        float(bool(_AT_WORD.search(s)) and bool(re.search(r"\.[A-Za-z]{2,}\Z|[\[(]dot[\])] ?[A-Za-z]{2,}\Z", s, re.I))),
        len(host) if "@" in s else 0,
        float("." in host) if "@" in s else 0.0,
        float(before.isalnum()),
        float(before in (".", "-", "/", "+", "(")),
        float(after.isalnum()),
        float(after in ("-", "/", ")")) + 2 * float(after == "." and right[1:2].isdigit()),
        float(before in ("", " ", "\n")),
        float(after in ("", " ", "\n", ",", ".", ";")),
        float(bool(words & CONTEXT_WORDS[kind])),
        sum(c.isdigit() for c in near) / 48,
        sum(c.isalpha() for c in near) / 48,
        sum(not c.isalnum() and not c.isspace() for c in near) / 48,
    ]


@dataclass
class Trees:
    """Depth-limited boosted trees for the logistic loss on quantile bins."""

    start: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    thresholds: dict = field(default_factory=dict)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        rate = min(max(y.mean(), 0.01), 0.99)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, p - y, np.maximum(p * (1 - p), 1e-6), DEPTH)
            self.trees.append(tree)
            f += self._apply(tree, b)
        return self

    def _grow(self, b, g, h, depth):
        leaf = float(-RATE * g.sum() / (h.sum() + 1))
        if not depth or len(g) < 8:
            return leaf
        best, parent = (1e-6, None, None), g.sum() ** 2 / (h.sum() + 1)
        for i, e in enumerate(self.edges):
            gs = np.cumsum(np.bincount(b[:, i], g, len(e) + 1))[:-1]
            hs = np.cumsum(np.bincount(b[:, i], h, len(e) + 1))[:-1]
            if len(gs):
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - parent
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], i, k)
        if best[1] is None:
            return leaf
        left = b[:, best[1]] <= best[2]
        if left.all() or not left.any():
            return leaf
        return best[1], best[2], self._grow(b[left], g[left], h[left], depth - 1), self._grow(b[~left], g[~left], h[~left], depth - 1)

    def _apply(self, tree, b) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        i, k, left, right = tree
        return np.where(b[:, i] <= k, self._apply(left, b), self._apply(right, b))

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._apply(t, b) for t in self.trees))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> None:
        """Per kind the lowest threshold above which precision holds; 2 (never) without both classes of the kind."""
        s = self.scores(x)
        for i, kind in enumerate(KINDS):
            at = kinds == i
            order = np.argsort(-s[at], kind="stable")
            hit, values = y[at][order], s[at][order]
            good = np.cumsum(hit) >= PRECISION * np.arange(1, len(hit) + 1)
            good &= values >= 0.5
            last = np.flatnonzero(good) if len(set(hit)) == 2 else []
            if len(last):  # half way to the best candidate that is left out
                below = values[last[-1] + 1] if last[-1] + 1 < len(values) else 0.0
                self.thresholds[kind] = max(0.5, float(values[last[-1]] + below) / 2)
            else:
                self.thresholds[kind] = 2.0


def examples_of(text: str) -> Iterator[tuple[int, list[float], int]]:
    """(offset, features, label) of a text's examples: 1 personal data, 0 not, 2 a candidate without a label."""
    base, _ = base_and_runs(text)
    inside = sorted((a, b) for _, a, b in base)
    for s in base:
        yield s[1], describe(text, s), 1
    for s in shifted(text, base):
        yield s[1], describe(text, s), 0
    ends = [b for _, b in inside]
    for s in generate(text, base):
        i = bisect_right(ends, s[1])
        touches = i < len(inside) and inside[i][0] < s[2]
        address = s[0] == "email" and (_ADDRESS.fullmatch(text, s[1], s[2]) or "@" not in text[s[1] : s[2]])
        if not address or touches:
            yield s[1], describe(text, s), 0 if touches or s[0] == "email" else 2
    for kind, a, b in base:
        left, right = text[max(0, a - 32) : a], text[b : b + 32]
        for new_kind, made, label in variants(kind, text[a:b]):
            yield a, describe(left + made + right, (new_kind, len(left), len(left) + len(made))), label
            other = {"card": "phone", "phone": "card"}.get(new_kind)
            if label and other and 13 <= len(_digits(made)) <= 15:
                yield a, describe(left + made + right, (other, len(left), len(left) + len(made))), 0


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, rows = ["doc_id", "start", "x", "y"], []
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            for start, x, y in examples_of(text):
                rows.append((doc_id, start, x, y))
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    yield pd.DataFrame(rows, columns=columns)


def doubtful(x: np.ndarray, y: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Unlabelled candidates that trees fitted on the labelled ones are sure of, where they are rare in their kind."""
    out, known, open_ = np.zeros(len(y), bool), (y < 2) & ~back, y == 2
    if open_.any() and len(set(y[known])) == 2:
        sure = open_ & (Trees().fit(x[known], y[known]).scores(x) >= SURE)
        for i in range(len(KINDS)):
            kind = open_ & (x[:, 0] == i)
            if (sure & kind).sum() <= max(DOUBT * kind.sum(), 20):
                out |= sure & kind
    return out


def fit(docs: DataFrame) -> Trees | None:
    """Trees from the candidates of a bounded sample of documents; None without both classes."""
    texts = _texts(docs).where("text RLIKE '[0-9@]'")
    picked = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    examples = materialize(
        texts.join(F.broadcast(picked.distinct()), "doc_id", "left_semi")
        .mapInPandas(returning_memory(_examples), "doc_id long, start long, x array<double>, y int")
        .withColumn("h", F.xxhash64("doc_id", "start")),
        "pii-examples",
    )
    # about SAMPLE rows leave the executors: the smallest hashes, by their share of the hash space
    total = examples.count()
    share = min(1.0, 1.1 * SAMPLE / max(total, 1))
    small = examples.where(F.col("h") < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else examples
    rows = sorted(small.collect(), key=lambda r: (r.h, r.doc_id or 0, r.start, r.x, r.y))[:SAMPLE]
    if 1 not in {r.y for r in rows} or len({r.y for r in rows}) < 2:
        return None
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    back = np.array([r.h % 4 == 0 for r in rows])
    keep = ~doubtful(x, y, back)
    x, y, back = x[keep], (y == 1).astype(float)[keep], back[keep]
    model = Trees().fit(x[~back], y[~back]) if len(set(y[~back])) == 2 else Trees().fit(x, y)
    model.calibrate(x[back], y[back], x[back][:, 0])
    return model


def find_all(texts: list[str], model: Trees | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and start; the candidates of all texts are scored together."""
    found = [base_and_runs(t)[0] for t in texts]
    candidates = [generate(t, base) if model is not None else [] for t, base in zip(texts, found)]
    rows = [describe(t, c) for t, cs in zip(texts, candidates) for c in cs]
    scores = model.scores(np.array(rows)).tolist() if rows else []
    order = lambda x: (KINDS.index(x[0]), x[1])
    out, at = [], 0
    for text, base, cs in zip(texts, found, candidates):
        s, at = scores[at : at + len(cs)], at + len(cs)
        best = sorted((-s[i], c[1], -c[2], KINDS.index(c[0])) for i, c in enumerate(cs) if s[i] >= model.thresholds[c[0]])
        added: list[Span] = []
        if best:
            taken = bytearray(len(text))
            for _, a, b in base:
                taken[a:b] = b"\1" * (b - a)
            for _, a, minus_b, kind in best:
                if taken.find(1, a, -minus_b) < 0:
                    added.append((KINDS[kind], a, -minus_b))
                    taken[a:-minus_b] = b"\1" * (-minus_b - a)
        out.append((sorted(base, key=order), sorted(base + added, key=order)))
    return out


def find(text: str, model: Trees | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    return find_all([text], model)[0]


#: Texts whose candidates are scored together.
TOGETHER = 256


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    model = fit(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, texts = [], pdf["text"].tolist()
            spans_of = [x for i in range(0, len(texts), TOGETHER) for x in find_all(texts[i : i + TOGETHER], model)]
            for doc_id, (base, spans) in zip(pdf["doc_id"], spans_of):
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return _texts(docs).mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by ``<KIND>``; overlapping spans merge under the first kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` set to the new length; null texts stay."""
    model = fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the other columns pass as they are: no detour of long integers over floats
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = batch.column(at).to_pylist()
            texts = []
            for i in range(0, len(old), TOGETHER):
                part = old[i : i + TOGETHER]
                spans_of = find_all([t or "" for t in part], model)
                texts += [None if t is None else redacted(t, spans) for t, (_, spans) in zip(part, spans_of)]
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(returning_memory(run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
