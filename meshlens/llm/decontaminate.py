"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A benchmark item is found in a document where a window of its words is within an edit distance of the
item. A CGK random walk copies the word under a pointer to every output position and moves on by a random
bit of that word, so that windows at small edit distance become sequences at small Hamming distance.
Repeated samples of output positions (bit sampling) are the keys that windows and items of one size band
must share; walks and samples are repeated to reach the recall. Each candidate is verified by its exact
edit distance.

Documents are only mapped over: no shuffle, whatever the copies. Items are the query set and come in
blocks of a bounded number of rows, each broadcast. Before windows are embedded, those that hold too few of
the items' word pairs for any match are dropped; r edits destroy 2r pairs at most, so this loses nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import plain

#: Items of a block (that much is broadcast at once), and the ratio of sizes within a band.
BLOCK_ITEMS, BAND = 20_000, 1.25
#: Random walks, samples of each walk, and output positions of a sample.
WALKS, SAMPLES, POSITIONS = 8, 4, 3
_PAD = np.uint64(0x5851F42D4C957F2D)


class Band:
    """Items of ``low`` to ``low * BAND`` words, and their keys in every table."""

    def __init__(self, low: int, items: list[int], words: list[np.ndarray], max_edit: float):
        self.low, self.items = low, items
        self.most = int(max_edit * max(len(words[i]) for i in items))
        self.steps = 2 * low
        rng = np.random.default_rng(7 * low + 1)
        self.picks = [[np.sort(rng.choice(self.steps, min(POSITIONS, self.steps), replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        flat = np.concatenate([np.concatenate([words[i], np.full(self.steps, _PAD)]) for i in items])
        starts = np.cumsum([0] + [len(words[i]) + self.steps for i in items])[:-1]
        self.tables = []
        for walk in range(WALKS):
            for keys in self.keys(flat, starts, walk):
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], np.array(items)[order]))

    def keys(self, flat: np.ndarray, starts: np.ndarray, walk: int) -> list[np.ndarray]:
        """Keys of one walk from ``starts`` over the word hashes ``flat``, one array a sample."""
        at, salt = starts.copy(), np.uint64(walk * 0x9E3779B9 + 1)
        picks = self.picks[walk]
        out = [np.full(len(starts), i, np.uint64) for i in range(len(picks))]
        for step in range(self.steps):
            word = flat[np.minimum(at, len(flat) - 1)]
            for k, own in enumerate(picks):
                if step in own:
                    out[k] = kernels.mix(out[k] * np.uint64(0x100000001B3) ^ word)
            at += ((kernels.mix(word ^ salt * np.uint64(step // 64 + 1)) >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
        return out


class Index:
    """Everything a task needs to search one block of items."""

    def __init__(self, ids: list[int], texts: list[str], max_edit: float, min_words: int):
        w = split(pa.array(texts, pa.large_string()))
        words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(texts))]
        kept = [i for i, x in enumerate(words) if len(x) >= min_words]
        self.ids, self.words, self.max_edit = ids, words, max_edit
        self.sets = {i: set(words[i].tolist()) for i in kept}
        bands: dict[int, list[int]] = {}
        for i in kept:
            low = float(min_words)
            while len(words[i]) >= int(low * BAND) + 1:
                low = int(low * BAND) + 1
            bands.setdefault(int(low), []).append(i)
        self.bands = [Band(low, items, words, max_edit) for low, items in sorted(bands.items())]
        pairs = [pair_hashes(words[i]) for i in kept]
        size = 1 << max(20, int(16 * sum(map(len, pairs))).bit_length())
        self.mask, self.pairs = np.uint64(size - 1), np.zeros(size, bool)
        if pairs:
            self.pairs[(np.concatenate(pairs) & self.mask).astype(np.int64)] = True

    def search(self, w: kernels.Words) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, first word, end word) of the best place of each item in each document."""
        n = len(w.hash)
        if n < 2 or not self.bands:
            return []
        known = self.pairs[(pair_hashes(w.hash) & self.mask).astype(np.int64)] & (w.doc[1:] == w.doc[:-1])
        total = np.concatenate([[0], np.cumsum(known)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for band in self.bands:
            need = band.low - 1 - 2 * band.most
            ends = np.minimum(np.arange(n) + band.low - 1, n - 1)
            starts = np.flatnonzero(total[ends] - total[np.arange(n)] >= max(need, 1))
            if not len(starts):
                continue
            tables = iter(band.tables)
            found: set[tuple[int, int]] = set()
            for walk in range(WALKS):
                for keys in band.keys(w.hash, starts, walk):
                    own, items = next(tables)
                    a, b = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
                    for i in np.flatnonzero(a < b).tolist():
                        p = int(starts[i])
                        found.update((int(item), p) for item in items[a[i] : b[i]])
            done: dict[tuple[int, int], int] = {}
            for item, p in sorted(found):
                pattern, doc = self.words[item], int(w.doc[p])
                r = int(self.max_edit * len(pattern))
                if done.get((doc, item), -1) > p:
                    continue
                low, high = max(int(w.first[doc]), p - len(pattern)), min(int(w.first[doc + 1]), p + 2 * len(pattern) + r)
                text = w.hash[low:high].tolist()
                if sum(x in self.sets[item] for x in text) < len(pattern) - r:
                    continue
                distance, begin, end = nearest(pattern.tolist(), text)
                if distance <= r:
                    place = (distance, low + begin - int(w.first[doc]), low + end - int(w.first[doc]))
                    best[doc, item] = min(best.get((doc, item), place), place)
                    done[doc, item] = low + end
        return [(doc, item, *place) for (doc, item), place in sorted(best.items())]


def split(texts: pa.Array) -> kernels.Words:
    return kernels.words(pc.utf8_lower(texts), kernels.NON_ALNUM)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return kernels.mix(words[:-1] * np.uint64(3) + (words[1:] ^ np.uint64(0x2545F491)))


def nearest(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, begin, end) of the substring of ``text`` with the smallest edit distance from ``pattern``; earliest end, then longest."""
    distance, end = _smallest(pattern, text)
    back, length = _smallest(pattern[::-1], text[:end][::-1], anchored=True)
    return distance, end - length, end


def _smallest(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """Bit-parallel edit distances to the substrings of ``text`` (with ``anchored``, its prefixes): the smallest, and its end."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, x in enumerate(text):
        eq = masks.get(x, 0)
        across = eq | minus
        eq |= (((eq & plus) + plus) ^ plus)
        up, down = (minus | ~(eq | plus)) & full, plus & eq
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus, minus = (down | ~(across | up)) & full, up & across
        if score < best:
            best, end = score, j + 1
    return best, end


def _search(index):
    def run(batches):
        for batch in batches:
            for row, texts in kernels.chunks(batch, "text"):
                rows = index.value.search(split(texts))
                if rows:
                    docs = batch.column("doc_id").take(pa.array([row + x[0] for x in rows], pa.int64()))
                    item, distance, begin, end = zip(*[x[1:] for x in rows])
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array([index.value.ids[i] for i in item], pa.int64()), *[pa.array(c, pa.int64()) for c in (distance, begin, end)]],
                        names=["doc_id", "item_id", "distance", "start_word", "end_word"],
                    )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, min_words: int = 8) -> DataFrame:
    """Places of ``benchmark`` items (item_id, text) in ``docs`` (doc_id, text).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased.
    An item of n words is found where an edit distance over words of at most ``floor(max_edit * n)`` is left; items
    of fewer than ``min_words`` words, or null, can't be told from chance and are never found. Returns one row
    per row of ``docs`` and item: doc_id, item_id, distance, start_word, end_word of the nearest place (the
    first of several). The LSH misses few places (see the tests for its recall) and reports no wrong ones.
    Null and empty texts hold nothing; null ids and repeated rows are reported as they are; extra columns are
    ignored; empty tables give an empty result.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", docs["doc_id"].cast("long"))
    shape = "doc_id long, item_id long, distance long, start_word long, end_word long"
    found = (docs.mapInArrow(_search(index), shape) for index in _indexes(benchmark, max_edit, min_words))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, min_words: int = 8) -> DataFrame:
    """The rows of ``docs`` (text) in which ``leaks`` finds no item, with all their columns."""
    for index in _indexes(benchmark, max_edit, min_words):
        docs = docs.mapInArrow(_without(index), docs.schema)
    return docs


def _indexes(benchmark: DataFrame, max_edit: float, min_words: int):
    """Broadcast indexes of the blocks of ``benchmark``; a block has about ``BLOCK_ITEMS`` items."""
    items = plain(benchmark, "item_id", "text").where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for i in range(blocks):
        part = items.where(block == i).select(F.col("item_id").cast("long"), "text").toArrow()
        part = part.sort_by([("item_id", "ascending"), ("text", "ascending")])
        index = Index(part["item_id"].to_pylist(), part["text"].to_pylist(), max_edit, min_words)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def _without(index):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, texts in kernels.chunks(batch, "text"):
                for found in index.value.search(split(texts)):
                    keep[row + found[0]] = False
            yield batch.filter(pa.array(keep))

    return run
