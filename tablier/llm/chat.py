"""Operator 10: chat formatting with layouts recognised by schema fingerprints.

The fingerprint of a record layout is a hash of its sorted nested field paths.
It selects a declarative mapping (``LAYOUTS``) that turns the layout into
canonical turns (conv_id, turn, role, text): flat turn rows, message lists,
prompt/response pairs and instruction/input/output records. A new layout is a
new entry, not new code.

Template: each turn is ``### Role: text</turn>`` and a line feed. Inside texts a
backslash is put before ``\\``, ``#`` of a ``###`` run start and ``</turn>``, so
no text can forge a mark and the text reads back exactly. The loss mask covers
the escaped text of assistant turns, without marks.

Null text counts as empty, null role as ``user``. Turns are ordered by turn,
then role, then text (null turns first); repeated rows stay. Rows without
conv_id are left out. The layout is that of the exact fingerprint, else the known
one with most paths inside the schema (then the one listed first); columns beyond
it are not read. Turns are formatted, read back and counted where they are; only
the running digests of a conversation need its turns in order, and stream over
sorted rows, so a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>\n"
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*): ", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group(1), text)


def _role_mark(role: str) -> str:
    """Role with its first letter raised when that is reversible; marks, colons and line feeds are escaped."""
    out = escape(role).replace(":", "\\c").replace("\n", "\\n")
    return out[:1].upper() + out[1:] if role[:1].islower() and role[:1].upper().lower() == role[:1] and len(role[:1].upper()) == 1 else "=" + out


def _role_of(mark: str) -> str:
    out = mark[1:] if mark.startswith("=") else mark[:1].lower() + mark[1:]
    return re.sub(r"\\(\\|###|</turn>|c|n)", lambda m: {"c": ":", "n": "\n"}.get(m.group(1), m.group(1)), out)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and start and end of its text."""
    head = f"### {_role_mark(role)}: "
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.match(formatted)
    if not m or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    return _role_of(m.group(1)), unescape(formatted[m.end() : -len(END)])


# ---------------------------------------------------------------- layouts


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted nested paths of the fields, lower-cased; array elements are ``[]``."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}".lstrip(".")))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """``paths`` that identify the layout, and its turns: a list column to open, or (role, column) pairs."""

    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None  # turn, role and text column of flat rows
    messages: tuple[str, str, str] | None = None  # list column, role and text field
    parts: tuple[tuple[str, str], ...] = ()  # role and column


LAYOUTS = {
    fingerprint(list(x.paths)): x
    for x in (
        Layout(("conv_id", "turn", "role", "text"), rows=("turn", "role", "text")),
        Layout(("conv_id", "messages[].role", "messages[].content"), messages=("messages", "role", "content")),
        Layout(("conv_id", "conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
        Layout(("conv_id", "prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
        Layout(("conv_id", "prompt", "completion"), parts=(("user", "prompt"), ("assistant", "completion"))),
        Layout(("conv_id", "instruction", "input", "output"), parts=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
        Layout(("conv_id", "instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    )
}
# Names that other layouts give the three roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_of(schema: T.StructType) -> Layout:
    """The layout with this fingerprint; else the one with most paths among those the schema contains, in listed order."""
    paths = field_paths(schema)
    hit = LAYOUTS.get(fingerprint(paths))
    if hit is None:
        inside = [x for x in LAYOUTS.values() if set(x.paths) <= set(paths)]
        if not inside:
            raise ValueError(f"no layout for the fields {paths}")
        hit = max(inside, key=lambda x: len(x.paths))
    return hit


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of any known layout."""
    x = layout_of(records.schema)
    conv = F.col("conv_id").cast("long").alias("conv_id")
    if x.rows:
        turn, role, text = x.rows
        out = records.select(conv, F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    elif x.messages:
        column, role, text = x.messages
        opened = records.select(conv, F.posexplode(column).alias("turn", "m"))
        out = opened.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text"))
    else:
        parts = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.col(c).alias("text")) for i, (r, c) in enumerate(x.parts)]
        out = records.select(conv, F.explode(F.array(*parts)).alias("p")).select("conv_id", "p.turn", "p.role", "p.text")
        out = out.where("role <> 'user' OR coalesce(text, '') <> '' OR turn = 0")
    names = F.create_map(*[F.lit(v) for pair in ROLE_NAMES.items() for v in pair])
    role = F.coalesce(F.col("role"), F.lit("user"))
    return out.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", (role if x.rows else F.coalesce(names[role], role)).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [format_turn(r, t) for r, t in zip(pdf["role"], pdf["text"])]
        yield pd.DataFrame(
            {
                "conv_id": pdf["conv_id"],
                "turn": pdf["turn"],
                "formatted": [f for f, _, _ in made],
                "loss_start": [a if r == "assistant" else 0 for r, (_, a, _) in zip(pdf["role"], made)],
                "loss_end": [b if r == "assistant" else 0 for r, (_, _, b) in zip(pdf["role"], made)],
            }
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): the formatted turns with the loss mask, formatted where they are."""
    return turns.mapInPandas(_format, "conv_id long, turn long, formatted string, loss_start int, loss_end int")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        turns = [parse_turn(f) for f in pdf["formatted"]]
        masked = [unescape(f[a:b]) for f, a, b in zip(pdf["formatted"], pdf["loss_start"], pdf["loss_end"])]
        yield pd.DataFrame(
            {
                "conv_id": pdf["conv_id"],
                "turn": pdf["turn"],
                "role": [r for r, _ in turns],
                "text": [t for _, t in turns],
                # masked text that is the turn's own does not travel twice
                "masked": [None if m == t else m for m, (_, t) in zip(masked, turns)],
                "loss": [len(m) for m in masked],
                "chars": [len(f) for f in pdf["formatted"]],
            }
        )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, now = [], None
    n = loss = chars = 0
    turns_hash = loss_hash = None
    for pdf in batches:
        for conv, role, text, masked, turn_loss, turn_chars in zip(*(pdf[c].tolist() for c in ("conv_id", "role", "text", "masked", "loss", "chars"))):
            if conv != now:
                if now is not None:
                    rows.append((now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
                now, n, loss, chars = conv, 0, 0, 0
                turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
            n, loss, chars = n + 1, loss + turn_loss, chars + turn_chars
            turns_hash.update(f"{role}\n{text}\n".encode())
            loss_hash.update((text if masked is None else masked).encode())
        yield pd.DataFrame(rows, columns=_COLUMNS)
        rows = []
    if now is not None:
        yield pd.DataFrame([(now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars)], columns=_COLUMNS)


_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation from the formatted turns alone."""
    parsed = formatted.mapInPandas(_parse, "conv_id long, turn long, role string, text string, masked string, loss long, chars long")
    dealt = parsed.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.drop("turn").mapInPandas(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks."""
    text = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
