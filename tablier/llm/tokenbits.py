"""Operator 7: token ids as fixed-width bit-packed blocks.

File format: a folder of Parquet parts, one row per block, one block per run
of consecutive documents. ``shard, block`` give the order; ``payload`` is

    magic b"TBP1", u8 bits, 3 zero bytes, u32 documents, u32 ids   (16 bytes)
    i64 doc_id per document
    u32 end offset (in ids of this block) per document
    ids, each in ``bits`` bits, least significant bit first, zero padded

``bits`` is the minimum that holds the vocabulary's largest id. Block offsets
(``start_in_shard``, counted in ids) and the documents' offsets find any id
without reading other blocks, and a block unpacks in a few numpy operations.

Texts are encoded by the tokenizers library. Its pre-tokenizer never joins
across ASCII white space, so a batch of texts is cut there and its pieces are
interned at once: distinct pieces, encoded once per worker while they are
cached, and a code per piece; ids are then gathered by one numpy take. Long
texts go through in slices cut at white space. Texts are encoded where they are
read, so that only their ids are shuffled into ranges of doc_id, the shards;
the ranges come from the keys alone, and a text finds its own by binary search.

Null texts count as empty; every document ends with the end id, so an empty
one has one id. Documents are ordered by doc_id, repeated ids by a hash of
their text (equal rows are interchangeable); rows without doc_id are left
out. A doc_id with a third of all rows is split over ranges. Extra columns are
not read. The ids of a document are held whole by one task, and a block holds
at least one document.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablier.session import scratch_path

from .common import materialize, text_or_empty

MAGIC = b"TBP1"
#: Ids gathered before a block is closed.
BLOCK_IDS = 1 << 18
#: Distinct pieces kept per worker; beyond them those of the latest batch stay.
CACHE_PIECES = 800_000
#: Shards whose offsets one window row sums.
SHARD_GROUP = 1024
#: Text bytes per shard.
SHARD_BYTES = 16 << 20
#: Characters of texts that are cut into pieces together.
SLICE_CHARS = 6 << 20

_SPACE = re.compile(r"[ \t\n\x0b\f\r]")
_ENCODERS: dict[str, "PieceEncoder"] = {}


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    plane = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(plane.ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first``; reads only the bytes that hold them."""
    if bits in (16, 32):
        width = bits // 8
        return np.frombuffer(data, f"<u{width}", count, first * width).astype(np.uint32)
    lo = first * bits
    raw = np.frombuffer(data, np.uint8)[lo // 8 : (lo + count * bits + 7) // 8]
    plane = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + count * bits].reshape(count, bits)
    return (plane.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_block(doc_ids: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    ends = np.cumsum([len(x) for x in ids]).astype("<u4")
    head = MAGIC + struct.pack("<B3xII", bits, len(doc_ids), int(ends[-1]))
    return head + np.array(doc_ids, "<i8").tobytes() + ends.tobytes() + pack_ids(np.concatenate(ids), bits)


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, int, bytes]:
    """(doc ids, end offsets, bits, packed ids) of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    bits, docs, _ = struct.unpack_from("<B3xII", payload, 4)
    ids_at = 16 + 12 * docs
    return (
        np.frombuffer(payload, "<i8", docs, 16),
        np.frombuffer(payload, "<u4", docs, 16 + 8 * docs),
        bits,
        payload[ids_at:],
    )


def _gather(ids: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids[at[c]:at[c + 1]]`` of all codes in a row, and where each ends (with a leading 0)."""
    begin, length = at[codes], at[codes + 1] - at[codes]
    after = np.concatenate(([0], np.cumsum(length)))
    return ids[np.repeat(begin - after[:-1], length) + np.arange(after[-1])], after


class PieceEncoder:
    """Ids of texts; every distinct white-space piece is encoded once while it is cached."""

    #: A special token between pieces keeps their ids apart within one call.
    def __init__(self, path: str, separator: str = "<|startoftext|>"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # only tokenizers known to lower-case and to part letters from punctuation fold their pieces
        normal = json.loads(self.tokenizer.to_str())
        steps = (normal.get("normalizer") or {}).get("normalizers", [])
        self.folds = any(x["type"] == "Lowercase" for x in steps) and "\\p{L}]+|" in json.dumps(normal.get("pre_tokenizer")).replace("\\\\", "\\")
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        self._forget()

    def _forget(self) -> None:
        #: number of each known piece, their ids in a row, and where each begins
        self.known: dict[str, int] = {}
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Encode unknown pieces; their numbers."""
        special = np.fromiter(("<|" in p for p in pieces), bool, len(pieces)) | (self.separator_id is None)
        order = np.argsort(special, kind="stable")
        n = len(pieces) - int(special.sum())
        pieces = [pieces[i] for i in order]
        groups = [pieces[i : min(i + 512, n)] for i in range(0, n, 512)]
        rows, sizes = [self.ids], []
        for enc in self.tokenizer.encode_batch_fast([self.separator.join(g) for g in groups], add_special_tokens=False):
            ids = np.array(enc.ids, np.uint32)
            mark = ids == self.separator_id
            edges = np.concatenate(([-1], np.flatnonzero(mark), [len(ids)]))
            rows.append(ids[~mark])
            sizes.append(np.diff(edges) - 1)
        for enc in self.tokenizer.encode_batch_fast(pieces[n:], add_special_tokens=False):
            rows.append(np.array(enc.ids, np.uint32))
            sizes.append(np.array([len(enc.ids)]))
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.ids = np.concatenate(rows)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = np.arange(first, first + len(pieces))
        return numbers

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and where each text's ids end."""
        column = pa.array(texts, pa.string())
        if self.folds:
            # the tokenizer lower-cases all text; doing so for A-Z beforehand merges pieces
            column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        lists = pc.ascii_split_whitespace(column)
        words = lists.flatten().dictionary_encode()
        ids, at = self._ids_of(words.dictionary)
        out, after = _gather(ids, at, words.indices.to_numpy())
        return out, after[np.diff(lists.offsets.to_numpy()).cumsum()]

    def _ids_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and where each begins (and the last ends)."""
        if not self.folds:
            return _gather(self.ids, self.at, self._codes(words))
        # "word," is "word" and ",": the pre-tokenizer parts letters from punctuation
        tailed = pc.match_substring_regex(words, "[a-z][.,]$")
        stems = pc.if_else(tailed, pc.utf8_rtrim(words, ".,"), words).dictionary_encode()
        tails = pc.if_else(tailed, pc.utf8_slice_codeunits(words, -1), ".").dictionary_encode()
        stem_code, tail_code = self._codes(stems.dictionary), self._codes(tails.dictionary, 2)
        tailed = tailed.to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.cumsum(tailed + 1) - 1  # each word is its stem and perhaps a tail
        parts = np.empty(len(words) + int(tailed.sum()), np.int64)
        parts[last] = tail_code[tails.indices.to_numpy()]
        parts[last - tailed] = stem_code[stems.indices.to_numpy()]
        ids, after = _gather(self.ids, self.at, parts)
        return ids, np.concatenate(([0], after[last + 1]))

    def _codes(self, pieces: pa.StringArray, spare: int = 0) -> np.ndarray:
        """Numbers of distinct pieces, unknown ones encoded first; ``spare`` pieces may exceed the cache."""
        pieces = pieces.to_pylist()
        codes = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(codes < 0)
        if len(unknown) and len(self.known) + len(unknown) > CACHE_PIECES + spare:
            self._forget()
            unknown = np.arange(len(pieces))
        if len(unknown):
            codes[unknown] = self._learn([pieces[i] for i in unknown])
        return codes


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _slices(text: str) -> list[str]:
    """The text in parts of about ``SLICE_CHARS`` characters, cut at ASCII white space."""
    out, at = [], 0
    while len(text) - at > SLICE_CHARS:
        cut = _SPACE.search(text, at + SLICE_CHARS)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def _shard(bounds: tuple[np.ndarray, np.ndarray, np.ndarray], doc_id: int, tie: int, row: int) -> int:
    """The number of bounds (doc_id, tie, row) at or below the key."""
    low, high = np.searchsorted(bounds[0], doc_id, "left"), np.searchsorted(bounds[0], doc_id, "right")
    return bisect_right(range(high), (tie, row), int(low), key=lambda i: (bounds[1][i], bounds[2][i])) if low < high else int(low)


def _encode(path: str, end_id: int, width: int, bounds):
    """Rows (shard, doc_id, tie, row, ids): the text's ids and the end id in ``width`` bytes each."""
    last = np.array([end_id], f"<u{width}").tobytes()
    names = ("doc_id", "tie", "row")

    def encoded(enc: PieceEncoder, keys: list[tuple], texts: list[str]) -> pa.RecordBatch:
        parts = [_slices(t) for t in texts]
        ids, ends = enc([x for p in parts for x in p])
        ids = ids.astype(f"<u{width}")
        ends = [0, *ends[np.cumsum([len(p) for p in parts]) - 1].tolist()]
        rows = [ids[a:b].tobytes() + last for a, b in zip(ends, ends[1:])]
        shards = pa.array([_shard(bounds.value, *k) for k in keys], pa.int32())
        columns = [pa.array(c, pa.int64()) for c in zip(*keys)]
        return pa.RecordBatch.from_arrays([shards, *columns, pa.array(rows, pa.binary())], ["shard", *names, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        keys, texts, held = [], [], 0
        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*names, "text"))):
                keys.append(key)
                texts.append(text)
                held += len(text)
                if held >= SLICE_CHARS:
                    yield encoded(enc, keys, texts)
                    keys, texts, held = [], [], 0
        if texts:
            yield encoded(enc, keys, texts)

    return run


def _write_blocks(bits: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, start, held = -1, 0, 0, 0
        docs: list[int] = []
        ids: list[np.ndarray] = []

        def flush():
            nonlocal block, start, docs, ids, held
            row = pd.DataFrame(
                {"shard": [shard], "block": [block], "start_in_shard": [start], "n_ids": [held], "payload": [write_block(docs, ids, bits)]}
            )
            block, start, docs, ids, held = block + 1, start + held, [], [], 0
            return row

        for pdf in batches:
            for s, doc_id, raw in zip(pdf["shard"], pdf["doc_id"], pdf["ids"]):
                if s != shard:
                    if docs:
                        yield flush()
                    shard, block, start = int(s), 0, 0
                docs.append(int(doc_id))
                ids.append(np.frombuffer(raw, f"<u{width}"))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def _read_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for shard, start, payload in zip(pdf["shard"], pdf["start_in_shard"], pdf["payload"]):
            doc_ids, ends, bits, packed = read_block(payload)
            ids = unpack_ids(packed, bits, 0, int(ends[-1])).astype("<u4")
            begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
            yield pd.DataFrame(
                {"shard": shard, "doc_id": doc_ids, "at": start + begins, "n_tokens": ends.astype(np.int64) - begins, "ids_crc32": crc}
            )


def _largest_id(tokenizer: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())


def _bounds(docs: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of shards and the first key (doc_id, tie, row) of each but the first, from the keys alone."""
    spark = docs.sparkSession
    keys = materialize(docs.select("doc_id", "tie", "row", F.octet_length("text").alias("b")), "token-keys")
    total = keys.agg(F.sum("b")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES + 1)
    dealt = keys.repartitionByRange(shards, "doc_id", "tie", "row").groupBy(F.spark_partition_id().alias("p"))
    firsts = sorted(tuple(r[0]) for r in dealt.agg(F.min(F.struct("doc_id", "tie", "row")).alias("k")).select("k").collect())
    return shards, tuple(np.array([k[i] for k in firsts[1:]], np.int64) for i in range(3))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode the texts and write the blocks in ascending doc_id order under ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("doc_id IS NOT NULL")
    docs = docs.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    bits = bits_for(_largest_id(tokenizer, end_id) + 1)
    width = 2 if bits <= 16 else 4
    shards, bounds = _bounds(docs)
    encoded = docs.mapInArrow(
        _encode(tokenizer, end_id, width, spark.sparkContext.broadcast(bounds)), "shard int, doc_id long, tie long, row long, ids binary"
    )
    dealt = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "tie", "row")
    blocks = dealt.select("shard", "doc_id", "ids").mapInPandas(
        _write_blocks(bits, width), "shard long, block long, start_in_shard long, n_ids long, payload binary"
    )
    blocks.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files alone."""
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # ids before each shard: within its group of SHARD_GROUP shards, and before that group
    sizes = sizes.withColumn("g", F.expr(f"shard div {SHARD_GROUP}"))
    inner = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("g").agg(F.sum("n").alias("t")).select("g", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("t0"))
    offsets = (
        sizes.withColumn("s0", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(groups, "g")
        .select("shard", (F.col("s0") + F.col("t0")).alias("before"))
    )
    rows = blocks.select("shard", "start_in_shard", "payload").mapInPandas(
        _read_blocks, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(offsets, "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, f"token-files-{uuid.uuid4().hex}")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
