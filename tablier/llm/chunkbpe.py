"""Operator 9: byte-level BPE over content-defined chunks, encoded once and repaired at the joins.

A rolling hash over 16 bytes cuts every text at content-defined places, so a
passage shared by documents gives the same chunks whatever surrounds it. Each
worker keeps a bounded cache of encoded chunks. Cuts fall anywhere, even inside
words, so every join is repaired: the span between the nearest certain token
boundaries on both sides is encoded again and spliced in; a chunk without such
boundaries is swallowed by a longer span, at most by the whole text. A certain
boundary is a space between two printable ASCII characters: the pre-tokenizer
always cuts there, both inside a chunk and in the whole text. The result equals
encoding the whole text.

The vocabulary is the tokenizers file; the chunks themselves are encoded by
tiktoken over the same ranks, tested to agree with the tokenizers library.
Special-token strings in a text are their ids, as in that library.

Null texts count as empty: no ids, empty text. Repeated rows are kept. Extra
columns are not read. A document is held whole by one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, mix64, text_or_empty

WINDOW = 16
#: One cut in this many bytes on average; a power of two.
MEAN_CHUNK = 512
#: Bytes of chunk text and ids that a worker may keep, in two generations.
CACHE_BYTES = 16 << 20
# Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CODECS: dict[str, "ChunkCodec"] = {}


def _byte_of_char() -> dict[str, int]:
    """Printable Latin-1 stands for itself; the other bytes follow from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkCodec:
    def __init__(self, path: str, mean_chunk: int = MEAN_CHUNK):
        import re

        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = _byte_of_char()
        ranks = {
            bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special
        }
        self.core = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.token_len = np.array([len(b) for b in self.token_bytes], np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.mask = np.uint64(mean_chunk - 1)
        self.new: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.old: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0
        self.reused = self.encoded = 0

    def _chunk(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the byte offset at which each of them ends."""
        hit = self.new.get(raw)
        if hit is None:
            hit = self.old.get(raw)
            if hit is None:
                ids = np.array(self.core.encode_ordinary(raw.decode("utf-8")), np.uint32)
                hit = ids, np.cumsum(self.token_len[ids])
                self.encoded += 1
            else:
                self.reused += 1
            self.new[raw] = hit
            self.held += len(raw) + 12 * len(hit[0]) + 400
            if self.held > CACHE_BYTES // 2:
                self.old, self.new, self.held = self.new, {}, 0
        else:
            self.reused += 1
        return hit

    def cuts(self, arr: np.ndarray) -> np.ndarray:
        n = len(arr)
        if n < 2 * WINDOW:
            return np.empty(0, np.int64)
        pw, inv = _powers(n + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * pw[:n], dtype=np.uint64)))
        h = mix64((total[WINDOW:] - total[:-WINDOW]) * inv[: n + 1 - WINDOW])
        at = np.flatnonzero((h & self.mask) == 0) + WINDOW
        at = at[at < n]
        return at[(arr[at] & 0xC0) != 0x80]

    def _plain(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8")
        arr = np.frombuffer(raw, np.uint8)
        cuts = self.cuts(arr)
        if not len(cuts):
            return self._chunk(raw)[0]
        printable = (arr > 32) & (arr < 127)
        sure = np.flatnonzero((arr[1:-1] == 32) & printable[:-2] & printable[2:]) + 1
        # the span around each cut between certain boundaries; the ends of the text are certain too
        left = np.searchsorted(sure, cuts, "left") - 1
        right = np.searchsorted(sure, cuts, "right")
        lo = np.where(left >= 0, sure[np.maximum(left, 0)], 0) if len(sure) else np.zeros(len(cuts), np.int64)
        hi = np.where(right < len(sure), sure[np.minimum(right, len(sure) - 1)], len(raw)) if len(sure) else np.full(len(cuts), len(raw))
        edges = np.concatenate(([0], cuts, [len(raw)]))
        out, done = [], 0
        k = 0
        while k < len(cuts):
            a, b, j = int(lo[k]), int(hi[k]), k
            while j + 1 < len(cuts) and lo[j + 1] <= b:
                j += 1
                b = max(b, int(hi[j]))
            if a > done:
                out.append(self._inside(raw, int(edges[k]), int(edges[k + 1]), done, a))
            out.append(self._span(raw[a:b]))
            done, k = b, j + 1
        if done < len(raw):
            out.append(self._inside(raw, int(edges[-2]), int(edges[-1]), done, len(raw)))
        return np.concatenate(out)

    def _span(self, raw: bytes) -> np.ndarray:
        return np.array(self.core.encode_ordinary(raw.decode("utf-8")), np.uint32)

    def _inside(self, raw: bytes, start: int, end: int, a: int, b: int) -> np.ndarray:
        """Ids of raw[a:b] out of the chunk raw[start:end]; both ends are certain boundaries."""
        ids, ends = self._chunk(raw[start:end])
        first = 0 if a == start else int(np.searchsorted(ends, a - start, "right"))
        last = int(np.searchsorted(ends, b - start, "right"))
        return ids[first:last]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = [
            np.array([self.special[p]], np.uint32) if p in self.special else self._plain(p) for p in self.split.split(text) if p
        ]
        return np.concatenate(parts)

    def decode(self, ids) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def codec(path: str) -> ChunkCodec:
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(path)
    return _CODECS[path]


def _digests(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        sha, dec = lambda b: hashlib.sha256(b).hexdigest(), c.decimal
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = c.encode(text).tolist()
                rows.append((doc_id, len(ids), sha(",".join([dec[i] for i in ids]).encode()), sha(c.decode(ids).encode())))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [c.encode(t).astype(np.int32) for t in pdf["text"]]})

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the ids themselves."""
    return _texts(docs).mapInPandas(_ids(tokenizer), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        c = codec(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [c.decode(i) for i in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    return _texts(docs).mapInPandas(
        _digests(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
