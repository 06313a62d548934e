"""Operator 13: cheapest repair of damaged conversations, by integer-minimum DAG search.

``damaged`` drops, empties, strips, repeats or re-roles turns by the crc32 of
``conv_id:turn``; ``repair`` finds the cheapest edits (keep, re-role, delete,
insert) whose role initials read ``(s?(ua)+)?``. The search is a DAG over (row,
state of that pattern). Every edge adds one scalar big integer: its high digits
are the cost, its low digits the edit's letter at its place in the audit
(``D I K R`` are the octal digits 1 to 4 in ASCII order, 0 pads the end). The
plain integer minimum so decides cost first, then the ASCII-least audit; the
audit is read off the digits of the winner.

Integers stay short for conversations of any length: after ``BLOCK_ROWS`` rows
the letters so far are stored and one digit, the order among the (at most four)
paths kept, takes their place above the next block's digits. Paths of equal cost
never are prefixes of one another (the longer one would have paid for more
insertions), so that order is all that later rows need. Each path carries the
running digest of its repaired text, so one ordered pass over the rows does
everything, in memory that does not grow with the texts.

What can be said of a row alone is settled before the rows are ordered: damage,
blank and truncated flags in the scan, and repeats of (role, text) by a
pre-aggregated count per conversation whose few results are joined back. Only
the pass itself needs a conversation's rows in order in one task, because the
digest of its text is sequential; it streams over sorted rows.

Null roles and texts are one space, as is a null conv_id or turn within the
crc32 key. The null conv_id is a conversation of its own. Rows are ordered by
turn (nulls first), then role, then text; repeated rows are duplicates. A blank
row is not also a duplicate or truncated. A conversation without rows after the
damage has zeros, an empty audit and the digest of the empty string; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast
from .merkle import crc32_sql

#: Rows whose audit letters one integer holds.
BLOCK_ROWS = 256
_BITS = 3
#: At most two insertions before a row, the row's own edit, and two insertions at the end.
_PLACES = 3 * BLOCK_ROWS + 2
_LETTERS = " DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
_COST = 1 << _BITS * (_PLACES + 1)
_SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; the role that u or a adds from each.
_START, _S, _U, _A = range(4)
_NEXT = {_START: (_U, "user"), _S: (_U, "user"), _U: (_A, "assistant"), _A: (_U, "user")}

RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): rows after the damage; dropped ones stay as marks with ``alive`` false."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        as_text("role").alias("role"),
        as_text("text").alias("text"),
        F.pmod(F.crc32(key), F.lit(20)).alias("code"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") != 0).alias("alive"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``blank``, ``open_end`` (last character no end of a sentence) and ``later`` (role and text stand at an earlier turn)."""
    body = F.rtrim("text", F.lit(_SPACES))
    rows = rows.withColumn("blank", body == "").withColumn("open_end", ~F.right(body, F.lit(1)).isin(".", "!", "?"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    keyed = rows.withColumn("digest", F.when(~F.col("blank") & F.col("alive"), F.sha2("text", 256)))
    groups = keyed.where("digest IS NOT NULL").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"))
    repeats = materialize(groups.where("first_place <> last_place").drop("last_place"), "repair-repeats")
    repeats = sized_broadcast(repeats, repeats.count()).select(
        F.col("conv_id").alias("r_conv"), F.col("role").alias("r_role"), F.col("digest").alias("r_digest"), "first_place"
    )
    joined = keyed.join(
        repeats, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("role") == F.col("r_role")) & (F.col("digest") == F.col("r_digest")), "left"
    )
    later = F.coalesce(F.col("first_place") < place, F.lit(False))
    return joined.select("conv_id", "turn", "role", "text", "alive", "blank", "open_end", later.alias("later"))


class Path:
    """The best path to a state: its integer, the number of letters in the block, earlier letters and running digest."""

    __slots__ = ("value", "places", "earlier", "digest")

    def __init__(self, value, places, earlier, digest):
        self.value, self.places, self.earlier, self.digest = value, places, earlier, digest


def _edge(value: int, places: int, letter: int, cost: int) -> tuple[int, int]:
    return value + cost * _COST + (letter << _BITS * (_PLACES - 1 - places)), places + 1


def _least(options: dict, state: int, option: tuple) -> None:
    if state not in options or option[0] < options[state][0]:
        options[state] = option


class Repair:
    """One conversation's search, fed row by row in order."""

    def __init__(self) -> None:
        self.paths = {_START: Path(0, 0, None, hashlib.sha256())}
        self.rows = 0

    def _before_row(self) -> dict[int, tuple]:
        """(value, places, source, lines) per state after at most two insertions."""
        best = {s: (p.value, p.places, s, ()) for s, p in self.paths.items()}
        for _ in range(2):
            layer = dict(best)
            for s, (value, places, source, lines) in best.items():
                to, role = _NEXT[s]
                _least(layer, to, (*_edge(value, places, _I, INSERT), source, (*lines, role + ":")))
            best = layer
        return best

    def feed(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        options: dict[int, tuple] = {}
        initial, extra = role[:1], TRUNCATED if truncated else 0
        for s, (value, places, source, lines) in self._before_row().items():
            _least(options, s, (*_edge(value, places, _D, DELETE), source, lines))
            if must_go:
                continue
            to, name = _NEXT[s]
            if initial == "s" and s == _START:
                _least(options, _S, (*_edge(value, places, _K, KEEP + extra), source, (*lines, f"{role}:{text}")))
            if initial == name[0]:
                _least(options, to, (*_edge(value, places, _K, KEEP + extra), source, (*lines, f"{role}:{text}")))
            else:
                _least(options, to, (*_edge(value, places, _R, REROLE + extra), source, (*lines, f"{name}:{text}")))
        self.paths = {s: self._follow(o) for s, o in options.items()}
        self.rows += 1
        if self.rows == BLOCK_ROWS:
            self._next_block()

    def _follow(self, option: tuple) -> Path:
        value, places, source, lines = option
        base = self.paths[source]
        digest = base.digest
        if lines:
            digest = digest.copy()
            joined = "\n".join(lines)
            digest.update((joined if source == _START else "\n" + joined).encode("utf-8", "surrogatepass"))
        return Path(value, places, base.earlier, digest)

    def _letters(self, path: Path) -> str:
        digits = path.value % (1 << _BITS * _PLACES)
        return "".join(_LETTERS[d] for i in range(path.places) if (d := digits >> _BITS * (_PLACES - 1 - i) & 7))

    def _next_block(self) -> None:
        order = sorted(self.paths, key=lambda s: self.paths[s].value % _COST)
        for rank, s in enumerate(order):
            p = self.paths[s]
            self.paths[s] = Path(p.value // _COST * _COST + (rank << _BITS * _PLACES), 0, (p.earlier, self._letters(p)), p.digest)
        self.rows = 0

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired text)."""
        ends = {s: o for s, o in self._before_row().items() if s in (_START, _A)}
        best = self._follow(min(ends.values(), key=lambda o: o[0]))
        parts, node = [self._letters(best)], best.earlier
        while node:
            node, letters = node
            parts.append(letters)
        return best.value // _COST, "".join(reversed(parts)), best.digest.hexdigest()


class _Conversation:
    def __init__(self) -> None:
        self.repair, self.before, self.initial = Repair(), None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.turn = None
        self.distinct = 0

    def row(self, turn, role, text, blank, open_end, later) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.distinct = turn, turn, self.distinct + 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        duplicate = not blank and (later or self.before == (turn, role, text))
        truncated = not blank and not duplicate and open_end
        self.initial, self.before = initial, (turn, role, text)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.feed(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.finish()


_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, talk = None, None
    for pdf in batches:
        done = []
        columns = (pdf[c].tolist() for c in ("conv_key", "turn_key", "role", "text", "alive", "blank", "open_end", "later"))
        for conv, turn, role, text, alive, blank, open_end, later in zip(*columns):
            if talk is None or conv != now:
                if talk is not None:
                    done.append((int(now) if now else None, *talk.result()))
                now, talk = conv, _Conversation()
            if alive:
                talk.row(int(turn) if turn else None, role, text, blank, open_end, later)
        if done:
            yield _frame(done)
    if talk is not None:
        yield _frame([(int(now) if now else None, *talk.result())])


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired text of every conversation after the damage."""
    rows = faults(damaged(conversations))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    # ids travel as text, where null is the empty string: no integer passes through floats
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{k}_key") for c, k in (("conv_id", "conv"), ("turn", "turn"))]
    return dealt.select(*keys, "role", "text", "alive", "blank", "open_end", "later").mapInPandas(_search, RESULT)


# ---------------------------------------------------------------- the same in DuckDB

_LINE = "CASE WHEN {v}.t IS NULL THEN '' ELSE {v}.t || chr(10) END || "


def _step(v: str, cost: str, letter: str, line: str | None) -> str:
    text = f"{v}.t" if line is None else _LINE.format(v=v) + line
    return f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || {letter}, 't': {text}}} END"


def _min(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _oracle() -> str:
    # w: after insertions before the row; n: after the row. A row that fits is kept, else re-roled
    gap2 = _min("v2", *(_step(v, "2", "'I'", "'user:'") for v in ("v0", "v1", "v3")))
    gap3 = _min("v3", _step("w2", "2", "'I'", "'assistant:'"))

    def take(v: str, name: str) -> str:
        fits = f"left(role, 1) = '{name[0]}'"
        edge = _step(v, f"CASE WHEN {fits} THEN 0 ELSE 2 END + cut", f"CASE WHEN {fits} THEN 'K' ELSE 'R' END", f"CASE WHEN {fits} THEN role ELSE '{name}' END || ':' || text")
        return f"CASE WHEN NOT gone THEN {edge} END"

    keep_s = f"CASE WHEN NOT gone AND left(role, 1) = 's' THEN {_step('v0', 'cut', "'K'", "role || ':' || text")} END"
    drop = lambda v: _step(v, "3", "'D'", None)
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS code FROM conversations),
 d AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
   CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
   FROM c, range(2) AS r(k) WHERE code <> 0 AND (k = 0 OR code = 3)),
 e AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
 f AS (SELECT *, body = '' AS is_blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_dup,
   left(role, 1) AS x, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y FROM e),
 g AS (SELECT *, is_blank OR is_dup AS gone, (NOT is_blank AND NOT is_dup AND right(body, 1) NOT IN ('.', '!', '?'))::INT AS cut FROM f),
 n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
   count(*) FILTER (is_dup) AS duplicate, sum(cut) AS truncated, count(*) FILTER (y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS illegal,
   max(i) AS last FROM g GROUP BY conv_id),
 none AS (SELECT NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS z),
 s AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}} AS v0, z AS v1, z AS v2, z AS v3 FROM n, none
   UNION ALL
   SELECT conv_id, i, {drop("v0")}, {_min(drop("v1"), keep_s)}, {_min(drop("w2"), *(take(v, "user") for v in ("v0", "v1", "w3")))},
     {_min(drop("w3"), take("w2", "assistant"))}
   FROM (SELECT *, {gap3} AS w3 FROM (SELECT g.conv_id, g.i, role, text, gone, cut, v0, v1, v2, v3, {gap2} AS w2
     FROM s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1))),
 p AS (SELECT q.conv_id, {_min("v0", "w3")} AS o FROM (SELECT *, {gap3} AS w3 FROM (SELECT s.*, {gap2} AS w2 FROM s)) q
   JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id AND n.last = q.i)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(o.c, 0) AS cost, coalesce(o.a, '') AS audit, sha256(coalesce(o.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
"""


ORACLE = _oracle()
