"""Packing of documents into fixed-length token sequences along a Hilbert curve.

Each document becomes a vector of hashed byte trigrams, projected to DIMS numbers; their Hilbert key orders the
documents (range partitions, sorted), so that a sequence holds pieces of similar documents. Each partition is cut into
full sequences; what is left at its end goes to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_or_empty
from .words import flat_bytes, slices

DIMS, BITS, BUCKETS, CAPACITY, END = 4, 8, 256, 2048, 1
#: Bytes of text handled at once; the curve's counts take about 60 times as many.
PART_BYTES = 1 << 19
#: Characters on which both libraries' splitting agrees; other texts, special tokens' strings among them, go to the
#: slower library that the vocabulary file belongs to. No-break and zero-width characters are not among them.
PLAIN_TEXT = r"^[\n\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{24f}]*$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (n, dims) with ``bits`` bits a dimension; nearby keys are nearby points."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for shift in range(bits - 1, 0, -1):
        q, low = 1 << shift, (1 << shift) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMS))


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert keys of texts; texts under three bytes are at the origin."""
    data, offsets = flat_bytes(texts)
    n = len(offsets) - 1
    counts = np.zeros((n, BUCKETS))
    if len(data) > 2:
        h = (data[:-2] * np.uint8(31) + data[1:-1] * np.uint8(17) + data[2:] * np.uint8(7)).astype(np.int32)
        lengths = np.diff(offsets)
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)[:-2]
        inside = doc == np.repeat(np.arange(n, dtype=np.int32), lengths)[2:]
        counts = np.bincount((doc * BUCKETS + h)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(float)
    share = counts / np.maximum(1, counts.sum(1, keepdims=True))
    flat = np.tanh(share @ _projection() * 4)
    return hilbert(np.clip(((flat + 1) / 2 * (1 << BITS)).astype(int), 0, (1 << BITS) - 1), BITS)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies: printable ones for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """Token ids by a byte-level BPE file. Plain texts go through the same ranks in a faster library; the file's own is
    loaded where a text needs it."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        self.path, letters = path, byte_alphabet()
        with open(path) as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.special = sorted(special)
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def model(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = pc.match_substring_regex(texts, PLAIN_TEXT)
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, s))
        return [
            self.fast.encode_to_numpy(t, disallowed_special=()) if p else np.array(self.model.encode(t, add_special_tokens=False).ids, np.uint32)
            for t, p in zip(texts.to_pylist(), plain.to_pylist(), strict=True)
        ]


@lru_cache(2)
def loaded(path: str) -> Coder:
    """The coder of a file, kept while a Python worker lives."""
    return Coder(path)


class Packer:
    """Cuts a stream of documents into sequences; ``out`` has a row for each piece."""

    def __init__(self, first_sequence: int, capacity: int):
        self.sequence, self.capacity, self.used, self.tail = first_sequence, capacity, 0, []

    def _place(self, doc, at: int, ids: np.ndarray, total: int) -> tuple:
        row = (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, self.used)
        self.used += len(ids)
        if self.used == self.capacity:
            self.sequence, self.used = self.sequence + 1, 0
        return row

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces of full sequences; what doesn't fill one yet waits."""
        waiting = sum(len(x[2]) for x in self.tail)
        self.tail.append((doc, 0, ids, len(ids)))
        if waiting + len(ids) >= self.capacity:
            yield from self._flush((waiting + len(ids)) // self.capacity * self.capacity)

    def _flush(self, n: int) -> Iterator[tuple]:
        tail, self.tail = self.tail, []
        for k, (doc, at, ids, total) in enumerate(tail):
            while len(ids) and n:
                m = min(len(ids), n, self.capacity - self.used)
                yield self._place(doc, at, ids[:m], total)
                at, ids, n = at + m, ids[m:], n - m
            if len(ids):
                self.tail = [(doc, at, ids, total), *tail[k + 1 :]]
                return

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences whose lengths are falling powers of two."""
        rest, full = sum(len(x[2]) for x in self.tail), self.capacity
        while rest:
            self.capacity = 1 << min(rest.bit_length() - 1, full.bit_length() - 1)
            yield from self._flush(self.capacity)
            rest -= self.capacity
        self.capacity = full


#: Mean bytes of text in a range of the curve, and most ranges: beyond them ranges grow, and are still streamed. Ranges hold
#: about as many rows each, so one of long documents has several times the bytes.
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document (SCHEMA).

    A document is its token ids, then END. Null and empty texts are END alone. Each id lies in exactly one piece;
    repeated rows and ids are packed as they come; a null id stays null. An empty table gives no pieces. ``capacity``
    must be a power of two. Sequence ids are unique, not dense.
    """
    prepare(df.sparkSession)
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text", PART_BYTES):
                yield pa.RecordBatch.from_arrays([s["doc_id"], s["text"], pa.array(curve_keys(s["text"]))], ["doc_id", "text", "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = loaded(path), Packer(TaskContext.get().partitionId() << 40, capacity)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for b in batches:
            for s in slices(b, "text", PART_BYTES):
                rows = []
                for doc, ids in zip(s["doc_id"].to_pylist(), coder.encode(s["text"]), strict=True):
                    rows += packer.add(doc, np.append(ids, np.uint32(END)))
                if rows:
                    yield batch(rows)
        if rows := list(packer.finish()):
            yield batch(rows)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / RANGE_BYTES)))
    ordered = docs.mapInArrow(keyed, "doc_id long, text string, key long").withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(ranges, "key", "tie").sortWithinPartitions("key", "tie")
    return ordered.select("doc_id", "text").mapInArrow(packed, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
