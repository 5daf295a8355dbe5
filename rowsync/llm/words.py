"""Batches of texts as arrays of distinct words and codes, by Arrow's compute functions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a task.
SLICE_BYTES = 3 << 20


@lru_cache(1)
def _trim():
    """The C library's way to return free memory to the system; nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return memory that is free in this process to the system: Python workers wait for tasks, and others need it then."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each; one row at least. Free memory goes back at the end."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), size, side="right")))
        yield batch.slice(at, n)
        at += n
    give_back()


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts in one array, and the n+1 offsets of the texts in it. Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spread(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each element of the lists: the list's position, the value."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+``: for each its document and code; the distinct words."""
    doc, flat = spread(pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
    full = pc.not_equal(pc.binary_length(flat), 0)
    doc, coded = doc[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()
    return doc, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the ranges [start, start + length), range after range."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
