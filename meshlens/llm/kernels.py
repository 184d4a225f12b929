"""Vectorised text kernels that run inside tasks on one Arrow batch.

Texts of a chunk are joined into one byte buffer, so that words, word hashes and word n-grams of
thousands of documents come from a few numpy passes. A chunk is bounded by bytes, not by rows; one
text longer than the bound is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1

#: Word separators as byte tables: white space, and everything in ASCII that is no letter or digit.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words up to so many bytes are sums of values drawn by byte and place; longer ones are hashed one by one.
TABLE_BYTES = 64
_VALUES = mix(np.arange(1, 256 * TABLE_BYTES + 1, dtype=np.uint64) * np.uint64(_BASE)).reshape(256, TABLE_BYTES)
_VALUES_LOWER = _VALUES[LOWER].ravel()
_VALUES = _VALUES.ravel()
_UPPER_TO_LOWER = LOWER.tobytes()


def _word_hashes(buffer: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the words; no arithmetic of the bytes alone, which words of regular make could meet in."""
    place = np.arange(len(raw), dtype=np.int32)
    if len(start):
        place[start[0] :] -= np.repeat(start.astype(np.int32), np.diff(np.append(start, len(raw))))
    place &= TABLE_BYTES - 1
    place += raw.astype(np.int32) * TABLE_BYTES
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_VALUES_LOWER if lower else _VALUES)[place], out=sums[1:])
    hashes = mix(sums[end] - sums[start])
    for i in np.flatnonzero(end - start > TABLE_BYTES).tolist():
        word = buffer[start[i] : end[i]]
        hashes[i] = xxhash.xxh64_intdigest(word.translate(_UPPER_TO_LOWER) if lower else word)
    return hashes


def texts_of(column: pa.Array) -> pa.Array:
    """Text column with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of row ranges of ``batch`` with about ``limit`` bytes of text each."""
    texts = texts_of(batch.column(text))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield row, texts.slice(row, stop - row)
        row = stop


@dataclass
class Words:
    """Words of a chunk of texts, in order: byte spans within ``buffer``, their document and 64-bit hashes."""

    buffer: bytes
    doc_start: np.ndarray  # of each document, in bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each document, its first word; one more entry at the end
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Split every text at ``separators``; with ``lower``, A-Z hash like a-z. Words never cross texts."""
    parts = texts.cast(pa.large_binary()).to_pylist()
    buffer = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    doc_start = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.empty(len(raw) + 1, bool)
    inside[0] = False
    np.logical_not(separators[raw], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    hashes = _word_hashes(buffer, raw, start, end, lower)
    first = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(len(parts)), np.diff(first))
    return Words(buffer, doc_start[:-1], start, end, doc, first, hashes)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all runs of ``n`` consecutive words within one document."""
    size = len(w.hash) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = (out + w.hash[i : i + size]) * np.uint64(_BASE)
    at = np.flatnonzero(w.doc[:size] == w.doc[n - 1 :])
    return at, mix(out[at])


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's bigint."""
    return x.view(np.int64)


def group_starts(x: np.ndarray) -> np.ndarray:
    """First index of each run of equal values of the sorted ``x``."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with ``counts[i]`` of ``values`` in row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
