"""Best-fit packing by minimum bin slack.

Per bin, a bitset subset-sum over the available lengths finds the fullest feasible combination that
holds the longest piece left; it is then removed. Only lengths matter, so the search runs on the
histogram of lengths (at most ``capacity`` entries, whatever the input) and a combination is taken for as
many bins as its lengths allow at once. Pieces get their place by rank among pieces of their length:
tasks number their own, small prefix sums over (length, task) make the numbers global, and a table of
the combinations turns a rank into sequence and offset. No piece moves through the driver, and no
length, however frequent, is gathered in one task.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import plain, small_side, staged

#: Bytes of words and ids that a worker keeps a generation; it keeps two.
GENERATION_BYTES = 48_000_000
#: What a kept word takes beside its letters and ids: two objects and its place in the table.
ENTRY_BYTES = 190
#: Unknown words that go to the tokenizer as one text.
TOGETHER = 500
#: Code points in which this module splits words exactly as the tokenizer does; other texts go to it whole.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e -ɏ]|<\|")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\s0-9a-zªµºß-öø-ɏ²³¹¼½¾]+")


class WordIds:
    """Ids of texts as bytes (little-endian unsigned 32-bit), by the tokenizer at ``path``.

    Words met keep their ids in two generations of bounded bytes: when the younger one is full it becomes the elder,
    and words looked up in the elder move on, so that words in use stay. Words unknown so far go to the tokenizer together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.size = 0

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """As ``_encoded`` for words of ``_SPLIT``: many go as one text with spaces between, which the tokenizer splits into the same words."""
        out = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.array(found.ids, "<u4"), found.word_ids  # a token added to the vocabulary has no word
            first = kernels.group_starts(np.array(owner, np.int64)) if None not in owner else ids[:0]
            if len(first) == len(part):
                data, ends = ids.tobytes(), [*(4 * first[1:]).tolist(), 4 * len(ids)]
                out += [data[a:b] for a, b in zip((4 * first).tolist(), ends)]
            else:
                out += self._encoded(part)
        return out

    def _ids(self, words: set[str]) -> dict[str, bytes]:
        """A table that has ``words``."""
        new = [x for x in words if x not in self.young]
        moved = {x: self.elder[x] for x in new if x in self.elder}
        unknown = [x for x in new if x not in moved]
        moved.update(zip(unknown, self._encoded_words(unknown)))
        self.size += sum(len(x) + len(ids) + ENTRY_BYTES for x, ids in moved.items())
        self.young.update(moved)
        table = self.young
        if self.size > GENERATION_BYTES:
            self.elder, self.young, self.size = self.young, {}, 0
        return table

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; equal texts are encoded once."""
        done, split = dict.fromkeys(texts, b""), {}
        for text in done:
            low = text.lower()  # some plain capitals have lower-case forms that aren't
            if "<|" not in low if low.isascii() and low.isprintable() else not _PLAIN.search(low):
                split[text] = _SPLIT.findall(low)
        whole = [x for x in done if x not in split]
        done.update(zip(whole, self._encoded(whole)))
        table = self._ids(set().union(*split.values()))
        done.update((x, b"".join(map(table.__getitem__, words))) for x, words in split.items())
        return [done[x] for x in texts]

    def of_text(self, text: str) -> bytes:
        return self.of_texts([text])[0]


_TOKENIZERS: dict[str, WordIds] = {}
_END = np.array([1], "<u4").tobytes()


def _pieces(path: str, capacity: int):
    """Pieces with their task and their number among the task's pieces of the same length."""

    def run(batches):
        if path not in _TOKENIZERS:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            _TOKENIZERS[path] = WordIds(path)
        ids = _TOKENIZERS[path]
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            docs = iter(batch.column("doc_id").to_pylist())
            found = (x for _, texts in kernels.chunks(batch, "text") for x in ids.of_texts(texts.to_pylist()))
            for doc, data in zip(docs, found):
                data += _END
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((doc, k, at // 4, length, zlib.crc32(part), task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_COLUMNS)

    return run


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "slot"]


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths (with repeats) of the largest total of at most ``room``, by a bitset of reachable totals.

    ``counts[l]`` pieces of length l are there. Longer ones come first; the search ends at an exact fit.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, size = min(int(counts[length]), room // length), 1
        while left > 0:
            many = min(size, left)
            steps.append((reach, length, many))
            reach |= (reach << (length * many)) & mask
            left, size = left - many, size * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, length, many in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * many
            total -= length * many
    return chosen


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until no piece is left. ``counts`` is indexed by length."""
    counts, plan = counts.copy(), []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            bin_ = [longest, *fullest(counts, capacity - longest)]
            counts[longest] += 1
            lengths, each = np.unique(bin_, return_counts=True)
            times = int((counts[lengths] // each).min())
            counts[lengths] -= times * each
            plan.append((bin_, times))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Rows sorted by (length, first rank): that rank's first bin, pieces per bin, place in the bin."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bin_, times in plan:
        offset = 0
        for length, each in zip(*(x.tolist() for x in np.unique(bin_, return_counts=True))):
            rows.append((length, used.get(length, 0), base, each, offset))
            used[length] = used.get(length, 0) + each * times
            offset += length * each
        base += times
    rows.sort()
    names = ("length", "rank", "base", "each", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def _place(table):
    def run(batches):
        t = table.value
        key = t["length"] << 45 | t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 45 | rank, side="right") - 1
            bin_, within = np.divmod(rank - t["rank"][at], t["each"][at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in _COLUMNS[:5]] + [pa.array(t["base"][at] + bin_), pa.array(t["offset"][at] + within * length)],
                names=[*_COLUMNS[:5], "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """Pack the tokens of all rows of ``docs`` (doc_id, text) into sequences of at most ``capacity``.

    A document is its ids and then id 1; only longer ones are cut, into pieces of ``capacity`` and a rest.
    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences have no gaps.
    Null and empty texts are the single id 1. Null ids and repeated rows are packed as rows of their own,
    extra columns are ignored, an empty table gives an empty result. A very long text is encoded whole, by itself;
    its words and ids must fit a worker's memory.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", docs["doc_id"].cast("long"))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, slot long"
    pieces = staged(docs.mapInArrow(_pieces(tokenizer, capacity), shape), "pieces")
    per_task = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "per_task")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    table = docs.sparkSession.sparkContext.broadcast(slots(plan_bins(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(small_side(staged(offsets, "offsets")), ["length", "task"]).withColumn("rank", F.col("slot") + F.col("before"))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(table), shape)
