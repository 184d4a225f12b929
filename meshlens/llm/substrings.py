"""Substring dedup: fuzzy passages that documents share, by collinear chaining.

Words of a text give k-mers, of which minimizers (the smallest hash in every window) are its seeds. A
seed's occurrences are joined with one reference occurrence of it, in the smallest text key that has it, so
N texts with a passage give N matches a seed, never N^2. The matches of a text with one reference are
merged along diagonals and chained in order by a Fenwick tree with gap costs; chains are aligned over
their gaps and beyond their ends with the words around each seed, which seeds carry along. What is left
with enough words and enough of them equal is a fuzzy passage.

The one text may be a wrong one: words that two texts share may have their seeds' references in as many others that hold bits of them.
So runs of shared seeds that are long enough for a passage, but in none, go to a next round, in which only such runs are references of each
other; short bits are no longer among them. When a round finds nothing or leaves over nine tenths of its seeds, what all rounds have left is compared
with every text that could share a passage with it, one by one: those that have one of its rare seeds, or two of its frequent ones at distances which
a passage has (``_spans``).

Equal texts are one text. The groups that tasks hold are the matches of a single text, which are no
more than its words; hot seeds are combined before the shuffle, and their join is one that Spark splits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import fresh, plain, small_side, staged

#: Words of a k-mer, k-mers of a window, words of context on either side of a seed.
K, WINDOW, CONTEXT = 7, 6, 11
MIN_WORDS, MIN_SAME, GAP_COST = 50, 0.75, 0.25
#: Words of the pieces that passages are put together from, and of their overlaps.
MIN_PIECE, MIN_OVERLAP = 14, 3


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def minimizers(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions (in the k-mers' order) that are the smallest of some window within their text; no run of equals."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for i in range(1, window):
        np.minimum(least, hashes[i : i + n], out=least)
    least[doc[:n] != doc[window - 1 :]] = 0
    most = np.zeros(len(hashes), np.uint64)
    for i in range(window):
        np.maximum(most[i : i + n], least, out=most[i : i + n])
    chosen = (most == hashes) & (most > 0)
    chosen[1:] &= hashes[1:] != hashes[:-1]
    return np.flatnonzero(chosen)


def _seeds(context: bool):
    """(seed, key, pos[, around]) of the texts of a task, each distinct text once as far as the task remembers."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, texts in kernels.chunks(batch, "text"):
                keys = [text_key(t) for t in texts.to_pylist()]
                new = [k not in seen and not seen.add(k) for k in keys]
                if len(seen) > 1_000_000:
                    seen.clear()
                w = kernels.words(texts, kernels.NON_ALNUM)
                at, hashes = kernels.ngrams(w, K)
                pick = minimizers(hashes, w.doc[at])
                pick = pick[np.array(new, bool)[w.doc[at[pick]]]]
                at, hashes = at[pick], hashes[pick]
                doc = w.doc[at]
                out = [pa.array(kernels.signed(hashes)), pa.array(np.array(keys, np.int64)[doc]), pa.array((at - w.first[doc]).astype(np.int32))]
                names = ["seed", "key", "pos"]
                if context:
                    # a byte of each word around; positions outside the text are 0, words never are
                    marks = np.concatenate([np.zeros(CONTEXT, np.uint8), (w.hash >> np.uint64(56)).astype(np.uint8) | 1, np.zeros(CONTEXT + K, np.uint8)])
                    offsets = np.concatenate([np.arange(CONTEXT), np.arange(CONTEXT + K, 2 * CONTEXT + K)])
                    around = marks[at[:, None] + offsets]
                    where = at[:, None] + offsets - CONTEXT
                    around[(where < w.first[doc][:, None]) | (where >= w.first[doc + 1][:, None])] = 0
                    out.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * CONTEXT), len(at), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary()))
                    names.append("around")
                if len(at):
                    yield pa.RecordBatch.from_arrays(out, names=names)

    return run


class Fenwick:
    """Largest (value, index) over a prefix."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, n: int) -> tuple[float, int]:
        """Over the first ``n`` entries."""
        found = (float("-inf"), -1)
        while n > 0:
            found = max(found, self.best[n])
            n -= n & -n
        return found


def chains(segments: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of (start, other start, length), best first, each segment in one chain at most."""
    n = len(segments)
    order = sorted(range(n), key=lambda i: segments[i])
    by_end = sorted(range(n), key=lambda i: segments[i][0] + segments[i][2])
    ends = sorted({b + size for _, b, size in segments})
    rank = {e: i for i, e in enumerate(ends)}
    tree, score, before, put = Fenwick(len(ends)), [0.0] * n, [-1] * n, 0
    bounds = np.array(ends)
    for i in order:
        a, b, size = segments[i]
        while put < n and segments[by_end[put]][0] + segments[by_end[put]][2] <= a:
            j = by_end[put]
            a1, b1 = segments[j][0] + segments[j][2], segments[j][1] + segments[j][2]
            tree.put(rank[b1], (score[j] + gap_cost * (a1 + b1), j))
            put += 1
        value, j = tree.get(int(np.searchsorted(bounds, b, "right")))
        gain = value - gap_cost * (a + b)
        score[i], before[i] = (size + gain, j) if gain > 0 else (float(size), -1)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], segments[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def same_words(x: bytes, y: bytes) -> int:
    """Words in the longest common subsequence of two short runs."""
    if x == y:
        return len(x)
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if a == b else max(row[j], row[j + 1])
    return row[-1]


def _extended(x: bytes, y: bytes) -> tuple[int, int]:
    """(words, equal words) of the best common run from the start: an equal word gains 1, another loses 2."""
    best = score = words = same = equal = 0
    for i, (a, b) in enumerate(zip(x, y)):
        if not a or not b:
            break
        equal += a == b
        score += 1 if a == b else -2
        if score > best:
            best, words, same = score, i + 1, equal
    return words, same


def aligned(d: np.ndarray, r: np.ndarray, own: np.ndarray, ref: np.ndarray, min_words: int, min_same: float):
    """(start, end, other start, other end, equal words) of the passages behind the matches of two texts.

    ``d`` and ``r`` are word positions of seeds in the two, ``own`` and ``ref`` rows of the bytes around them.
    """
    order = np.lexsort((d, d - r))
    d, r, own, ref = d[order], r[order], own[order], ref[order]
    same = own[:, CONTEXT:] == ref[:, CONTEXT:]
    run = np.where(same.all(axis=1), CONTEXT, np.argmin(same, axis=1))  # equal words after each seed
    step = np.diff(d)
    joined = (np.diff(d - r) == 0) & (step <= K + run[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.concatenate([first[1:], [len(d)]]) - 1
    segments = list(zip(d[first].tolist(), r[first].tolist(), (d[last] - d[first] + K).tolist()))
    out = []
    for chain in chains(segments):
        pieces, start = [], 0
        for i in range(1, len(chain)):
            a, b = segments[chain[i - 1]], segments[chain[i]]
            if max(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) > 2 * CONTEXT:
                pieces.append(chain[start:i])
                start = i
        for piece in [*pieces, chain[start:]]:
            lead, tail = first[piece[0]], last[piece[-1]]
            more, equal = _extended(own[lead, :CONTEXT][::-1].tobytes(), ref[lead, :CONTEXT][::-1].tobytes())
            begin, other = segments[piece[0]][0] - more, segments[piece[0]][1] - more
            more, tail_equal = _extended(own[tail, CONTEXT:].tobytes(), ref[tail, CONTEXT:].tobytes())
            end, other_end = (segments[piece[-1]][i] + segments[piece[-1]][2] + more for i in (0, 1))
            total = equal + tail_equal + sum(segments[i][2] for i in piece)
            for i, j in zip(piece, piece[1:]):
                gaps = [segments[j][x] - segments[i][x] - segments[i][2] for x in (0, 1)]
                sides = []
                for rows, gap in zip((own, ref), gaps):
                    after, prior = rows[last[i], CONTEXT:], rows[first[j], :CONTEXT]
                    run_ = after[:gap] if gap <= CONTEXT else np.concatenate([after, prior[2 * CONTEXT - gap :]])
                    sides.append(run_.tobytes())
                total += same_words(*sides)
            if end - begin >= min_words and other_end - other >= min_words and total >= min_same * max(end - begin, other_end - other):
                out.append((begin, end, other, other_end, total))
    return out


def merged(pieces: list[tuple], min_words: int, min_same: float) -> list[tuple]:
    """Passages (ref, start, end, other start, other end, equal words) of one text from pieces of all its references.

    A reference may hold but a part of what others hold whole. Pieces that overlap by some words are parts of one
    passage, which is given the reference of its longest piece.
    """
    out, group = [], []

    def close():
        if group:
            begin, end = group[0][0], max(x[1] for x in group)
            best = max(group, key=lambda x: (x[1] - x[0], -x[5]))
            equal, reached = 0, begin
            for x in group:  # words that a piece before has are not counted again
                equal += max(0, x[4] - max(0, min(reached, x[1]) - x[0]))
                reached = max(reached, x[1])
            if end - begin >= min_words and equal >= min_same * (end - begin):
                out.append((best[5], begin, end, best[2], best[3], equal))
            group.clear()

    for piece in sorted(pieces):
        if group and piece[0] > max(x[1] for x in group) - MIN_OVERLAP:
            close()
        group.append(piece)
    close()
    return out


def _runs(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of a text's seeds that lie no further apart than contexts reach; seeds are in order."""
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] - pos[:-1] > K + 2 * CONTEXT)]))
    return first, np.concatenate([first[1:], [len(key)]]) - 1


def unresolved(key: np.ndarray, pos: np.ndarray, own: np.ndarray, passages: list[tuple], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of seeds that another round should compare, which of them are free); ``own``: the text is the seed's reference.

    These are runs of seeds outside ``passages`` (key, start, end), of at least the words of a piece, with what lies within a passage's length
    of them, where that is long enough for a passage. A run of own seeds alone needs none: who shares it has been compared with it.
    Free are seeds whose words around are not all in one of ``passages``; with the others alone none can be found that reaches beyond these.
    """
    order = np.lexsort((pos, key))
    k, p = key[order], pos[order]
    free, reaching = np.ones(len(k), bool), np.ones(len(k), bool)
    for text, begin, end in passages:
        a, b = np.searchsorted(k, text), np.searchsorted(k, text, "right")
        free[a + np.searchsorted(p[a:b], begin) : a + np.searchsorted(p[a:b], end - K, "right")] = False
        reaching[a + np.searchsorted(p[a:b], begin + CONTEXT) : a + np.searchsorted(p[a:b], end - K - CONTEXT, "right")] = False
    at = np.flatnonzero(free)
    if not len(at):
        return at, free[:0]
    first, last = _runs(k[at], p[at])
    others = np.add.reduceat((~own[order[at]]).astype(np.int64), first) > 0
    first, last = at[first], at[last]
    todo = others & (p[last] - p[first] + K >= MIN_PIECE)
    first, last = first[todo], last[todo]
    place = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) * (int(p.max()) + min_words + 1)
    near = np.zeros(len(k) + 1, np.int64)
    np.add.at(near, np.searchsorted(place + p, place[first] + np.maximum(p[first] - min_words, 0)), 1)
    np.add.at(near, np.searchsorted(place + p, place[last] + p[last] + min_words, "right"), -1)
    at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    if not len(at):
        return at, free[:0]
    first, last = _runs(k[at], p[at])
    long_ = p[at[last]] - p[at[first]] + K + 2 * CONTEXT >= min_words
    at = at[np.repeat(long_, last - first + 1)]
    return order[at], reaching[at]


def _passages(min_words: int, min_same: float):
    """Passages, and with ``around`` the seeds for the next round, whose ``equal_words`` are 1 if they are free. Rows come sorted by (key, ref, pos, ref_pos); a text's rows may go on over batches."""

    def whole(table: pa.Table):
        ids = [table[c].to_numpy() for c in ("key", "ref", "pos", "ref_pos")]
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], axis=0)])  # tasks may have met a text each
        table = table.filter(pa.array(new))
        key, ref = (table[c].to_numpy() for c in ("key", "ref"))
        pos, ref_pos = (table[c].to_numpy().astype(np.int64) for c in ("pos", "ref_pos"))
        around, ref_around = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint8).reshape(-1, 2 * CONTEXT) for c in ("around", "ref_around"))
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])]))
        stop = np.concatenate([start[1:], [len(key)]])
        likely = (pos[stop - 1] > pos[start]) & (key[start] != ref[start])
        pieces: dict[int, list[tuple]] = {}
        for a, b in zip(start[likely].tolist(), stop[likely].tolist()):
            found = aligned(pos[a:b], ref_pos[a:b], around[a:b], ref_around[a:b], MIN_PIECE, min_same)
            if found:
                pieces.setdefault(int(key[a]), []).extend((*x, int(ref[a])) for x in found)
        rows = [(k, *x) for k, found in pieces.items() for x in merged(found, min_words, min_same)]
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.nulls(len(rows), pa.binary())], names=[*_PASSAGE, "around"])
        left, free = unresolved(key, pos, key == ref, [(r[0], r[2], r[3]) for r in rows], min_words)
        if len(left):
            none = pa.nulls(len(left), pa.int64())
            held = [pa.array(key[left]), pa.array(ref[left]), pa.array(pos[left]), none, pa.array(ref_pos[left]), none, pa.array(free.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*held, table["around"].combine_chunks().take(pa.array(left))], names=[*_PASSAGE, "around"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from whole(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from whole(held)

    return run


def _reach(min_words: int) -> tuple[int, int, int]:
    """Least and largest distance of two seeds of a text that every passage with one other text has, and the largest that the other may have them at.

    A chain's first and last seed lie within contexts of its ends, and seeds next to each other no further apart than contexts reach, so its first seed and
    the first one at the least distance or more are such two. Up to that one, the other text has a gap of its own after each seed at most.
    """
    low = max(0, min_words - 2 * CONTEXT - K)
    high = low + K + 2 * CONTEXT
    return low, high, high + 2 * CONTEXT * (max(0, low - 1) // K + 1)


def _spans(low: int, high: int):
    """(span, key, wider, closer), equal ones of a text once as far as the task remembers: each two seeds of a text in order, at distances of ``low`` to ``high`` words; with a column ``free`` only those with a free seed
    from the one to the other. ``wider`` and ``closer`` are the spans from the seed before the first one and up to the seed before the second one, 0 where these
    are none. Rows come sorted by (key, pos); few of the last ones are held."""

    def span(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return kernels.signed(kernels.mix(kernels.mix(a.view(np.uint64)) * np.uint64(3) + b.view(np.uint64)))

    def run(batches):
        held, seen, of = [np.zeros(0, np.int64)] * 4, set(), None
        for batch in batches:
            given = [batch.column(c).to_numpy().astype(np.int64) for c in ("seed", "key", "pos")]
            given.append(batch.column("free").to_numpy(zero_copy_only=False).astype(np.int64) if "free" in batch.schema.names else np.ones(len(batch), np.int64))
            done = len(held[0])
            seed, key, pos, free = (np.concatenate(x) for x in zip(held, given))
            before = np.concatenate([[0], np.cumsum(free)])
            step = 0 if low == 0 else 1
            while True:  # a distance in rows; each is at least one word
                at = np.arange(max(done, step), len(key))
                ahead = at[key[at] == key[at - step]]
                apart = pos[ahead] - pos[ahead - step]
                if step and not (len(ahead) and apart.min() <= high):
                    break
                ahead = ahead[(apart >= low) & (apart <= high) & (before[ahead + 1] > before[ahead - step])]
                if len(ahead):
                    i, prior, inner = ahead - step, np.maximum(ahead - step - 1, 0), np.maximum(ahead - 1, 0)
                    wider = np.where((i > 0) & (key[prior] == key[ahead]) & (pos[ahead] - pos[prior] <= high), span(seed[prior], seed[ahead]), 0)
                    closer = np.where((step > 0) & (pos[inner] - pos[i] >= low) & (before[ahead] > before[i]), span(seed[i], seed[inner]), 0)
                    rows = [span(seed[i], seed[ahead]), key[ahead], wider, closer]
                    order = np.lexsort(rows)  # a line repeated on and on gives the same ones again
                    new = np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in rows], axis=0)])
                    rows = [x[order[new]] for x in rows]
                    if of != key[-1] or len(seen) > 1_000_000:
                        of, seen = int(key[-1]), set()  # of the text that goes on in the next batch
                    own = np.flatnonzero(rows[1] == of)
                    new = np.ones(len(rows[0]), bool)
                    new[own] = [x not in seen and not seen.add(x) for x in zip(*(rows[c][own].tolist() for c in (0, 2, 3)))]
                    yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in rows], names=["span", "key", "wider", "closer"])
                step += 1
            if len(key):
                keep = (key == key[-1]) & (pos >= pos[-1] - high)
                held = [x[keep] for x in (seed, key, pos, free)]

    return run


#: Seeds that more places have are frequent; texts with one span of these are dealt into tiles of about so many.
HOT_SEED, SPAN_TILE = 32, 1024


def _with_pairs(min_words: int, min_same: float):
    """Passages of texts with others, one pair after the other. Rows come sorted by (key, ref): for each text one without ``ref``, whose ``places`` are its own
    frequent seeds, then those of its pairs: ``places`` of the other text's frequent seeds, ``rare`` matches."""

    def lists(column: pa.Array, *names: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(fields of the lists' items, those that are words around, row of each item)."""
        items = column.flatten()
        numbers = [items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names if "around" not in c]
        rows = [np.frombuffer(b"".join(items.field(c).to_pylist()), np.uint8).reshape(-1, 2 * CONTEXT) for c in names if "around" in c]
        return numbers, rows, np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))

    def run(batches):
        now, own, pieces = None, None, []
        for batch in batches:
            key, ref = batch.column("key").to_numpy(), batch.column("ref")
            first = ref.is_null().to_numpy(zero_copy_only=False)
            ref = ref.fill_null(0).to_numpy()
            (seed, at), (near,), row = lists(batch.column("places"), "seed", "pos", "around")
            (pos, ref_pos), (around, ref_around), rare = lists(batch.column("rare"), "pos", "ref_pos", "around", "ref_around")
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rows = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                if now is None or key[a] != now:
                    rows += [(now, *x) for x in merged(pieces, min_words, min_same)]
                    now, own, pieces = int(key[a]), None, []
                i, j = np.searchsorted(row, [a, b])
                if first[a]:
                    j = np.searchsorted(row, a + 1)
                    order = np.argsort(seed[i:j], kind="stable") + i
                    own = seed[order], at[order], near[order]
                    i, j, a = j, np.searchsorted(row, b), a + 1
                # each place of a seed in the text with its first one in each other text
                low, high = (np.searchsorted(own[0], seed[i:j], side) for side in ("left", "right"))
                n = high - low
                other = np.repeat(np.arange(i, j), n)
                mine = np.arange(len(other)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                c, d = np.searchsorted(rare, [a, b])
                sides = [np.concatenate(x) for x in ((own[1][mine], pos[c:d]), (at[other], ref_pos[c:d]), (own[2][mine], around[c:d]), (near[other], ref_around[c:d]), (row[other], rare[c:d]))]
                order = np.argsort(sides[4], kind="stable")
                sides = [x[order] for x in sides]
                pair = np.flatnonzero(np.concatenate([[True], np.diff(sides[4]) != 0])) if len(order) else order
                for x, y in zip(pair.tolist(), [*pair[1:].tolist(), len(order)]):
                    if sides[0][x:y].min() < sides[0][x:y].max():
                        found = aligned(*(z[x:y] for z in sides[:4]), MIN_PIECE, min_same)
                        pieces += [(*z, int(ref[sides[4][x]])) for z in found]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_PASSAGE)
        rows = [(now, *x) for x in merged(pieces, min_words, min_same)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_PASSAGE)

    return run


def _compared_with_all(left: DataFrame, found: DataFrame, min_words: int, min_same: float) -> DataFrame:
    """Passages of the seeds ``left`` (key, pos, free) with every text of ``found`` (seed, key, pos, around) that has a smaller key, whatever reference seeds have.

    Pairs of texts have a rare seed or a span of frequent ones in common, and a seed that is free (``unresolved``): without one, what they share has been found. Spans that many
    texts have are tiled, and no task holds their pairs; these are as many as the texts' square where a stretch of more words than ``_reach`` asks for, but no
    passage, is common to them all. A pair is one row, with the other text's seeds as a list.
    """
    low, high, others_high = _reach(min_words)
    found = found.select("seed", "key", "pos", "around", F.col("ref").alias("first"))
    mine = staged(found.join(small_side(left, 1_000_000), ["key", "pos"]), "mine")
    wanted = staged(mine.select("seed").distinct(), "wanted")
    theirs = staged(found.join(small_side(wanted), "seed", "left_semi"), "theirs")
    hot = staged(theirs.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEED).select("seed"), "hot")
    rare, often = ([x.join(small_side(hot), "seed", how) for x in (mine, theirs)] for how in ("left_anti", "left_semi"))
    around = F.struct("pos", "around")
    # pairs with a rare seed, by which a text has fewer partners than that; what it shares with its seeds' references has been compared already.
    # As in the rounds, a seed stands for its first place in the other text: a line that both repeat makes no product of its places
    places = rare[1].repartition("seed").groupBy("seed", F.col("key").alias("ref")).agg(F.min(around).alias("r"))
    met = rare[0].join(places, "seed").where("ref < key").select("key", "ref", "pos", F.col("r.pos").alias("ref_pos"), "around", F.col("r.around").alias("ref_around"), "first", "free")
    match = F.struct("pos", "ref_pos", "around", "ref_around")
    apart = [(F.max(c) - F.min(c)) >= low for c in ("pos", "ref_pos")]
    likely = (F.bool_or(F.col("first") != F.col("ref")) & apart[0] & apart[1]).alias("likely")
    met = staged(met.distinct().groupBy("key", "ref").agg(likely, F.bool_or("free").alias("open"), F.collect_list(match).alias("rare")), "met")  # no more than the text's seeds
    more = staged(often[0].groupBy("key").agg(F.bool_or("free").alias("more")), "more")
    pairs = met.select("key", "ref", "likely", "open").join(small_side(more), "key", "left").where("open AND (likely OR more IS NOT NULL) OR more").select("key", "ref")

    def spans(rows: DataFrame, most: int) -> DataFrame:
        rows = rows.select("seed", "key", "pos", "free").repartition("key").sortWithinPartitions("key", "pos")
        return rows.mapInArrow(_spans(low, most), "span long, key long, wider long, closer long")

    # pairs that share frequent seeds alone
    own = staged(spans(often[0], high).distinct(), "own")
    other = spans(often[1].withColumn("free", F.lit(True)), others_high)
    other = other.select("span", F.col("key").alias("ref"), F.col("wider").alias("w"), F.col("closer").alias("c"))
    # two texts that have the wider or the closer span in common, too, are a pair by that one: what makes no pair with any text goes before the texts meet
    alone = "(wider <> w OR w = 0) AND (closer <> c OR c = 0)"
    kinds = staged(own.groupBy("span", "wider", "closer").agg(F.max("key").alias("last")), "kinds").withColumnRenamed("span", "s")
    other = staged(other.join(small_side(kinds), F.expr(f"span = s AND ref < last AND {alone}"), "left_semi").distinct(), "other")
    sizes = other.groupBy("span").agg(F.ceil(F.count("*") / SPAN_TILE).cast("int").alias("tiles")).where("tiles > 1")
    sizes = staged(sizes, "sizes")
    tiles = F.coalesce("tiles", F.lit(1))
    own, other = (x.join(small_side(sizes), "span", "left").withColumn("tiles", tiles) for x in (own, other))
    own = own.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    other = other.withColumn("tile", F.pmod(F.xxhash64("ref"), F.col("tiles")).cast("int")).drop("tiles")
    pairs = pairs.union(own.join(other, ["span", "tile"]).where(f"ref < key AND {alone}").select("key", "ref"))
    pairs = staged(pairs.distinct(), "pairs")  # the smallest key keeps a passage
    place = F.struct("seed", "pos", "around")
    own = mine.select("key").distinct().join(often[0].distinct().groupBy("key").agg(F.collect_list(place).alias("places")), "key", "left")
    own = pairs.select("key").distinct().join(own, "key").select("key", F.lit(None).cast("long").alias("ref"), "places", F.lit(None).cast(met.schema["rare"].dataType).alias("rare"))
    firsts = often[1].groupBy(F.col("key").alias("ref"), "seed").agg(F.min(around).alias("r")).select("ref", "seed", "r.*")
    firsts = firsts.groupBy("ref").agg(F.collect_list(place).alias("places"))
    paired = pairs.join(met.select("key", "ref", "rare"), ["key", "ref"], "left").join(firsts, "ref", "left").select("key", "ref", "places", "rare")
    rows = own.unionByName(paired).repartition("key").sortWithinPartitions("key", "ref")
    return staged(rows.mapInArrow(_with_pairs(min_words, min_same), ", ".join(f"{c} long" for c in _PASSAGE)), "with-all")


_PASSAGE = ["key", "ref", "start_word", "end_word", "ref_start", "ref_end", "equal_words"]


def _keys(batches):
    for batch in batches:
        for row, texts in kernels.chunks(batch, "text"):
            keys = pa.array([text_key(t) for t in texts.to_pylist()], pa.int64())
            n = pa.array(kernels.words(texts, kernels.NON_ALNUM).count, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(texts)), keys, n], names=["doc_id", "key", "n_words"])


def passages_of_texts(docs: DataFrame, min_words: int = MIN_WORDS, min_same: float = MIN_SAME) -> DataFrame:
    """Passages by text key: key, ref, start_word, end_word, ref_start, ref_end, equal_words; ref is a smaller key."""
    texts = docs.select("text").where("text is not null")
    owner = F.struct("key", "pos", "around")
    seeds = texts.mapInArrow(_seeds(False), "seed long, key long, pos int")
    refs = seeds.groupBy("seed").agg(F.min("key").alias("ref"), F.max("key").alias("last")).where("ref <> last")
    refs = small_side(staged(refs.select("seed", "ref"), "refs"))
    found = texts.mapInArrow(_seeds(True), "seed long, key long, pos int, around binary").join(refs, "seed")
    found = staged(found, "matches")
    first = found.where("key = ref").groupBy("seed").agg(F.min(owner).alias("r"))
    first = first.select("seed", F.col("r.pos").alias("ref_pos"), F.col("r.around").alias("ref_around"))
    sides = ["key", "ref", "pos", "ref_pos", "around", "ref_around"]
    matches = found.where("key <> ref").join(first, "seed").select(*sides)
    # a text's own seeds only make its runs whole: they need no join
    selves = found.where("key = ref").select("key", "ref", "pos", F.col("pos").alias("ref_pos"), "around", F.lit(bytes(2 * CONTEXT)).alias("ref_around"))
    matches = matches.unionByName(selves)
    shape = ", ".join(f"{c} long" for c in _PASSAGE) + ", around binary"
    rounds, left, unresolved_ones = [], None, None
    while True:
        rows = matches.select(*sides).repartition("key").sortWithinPartitions("key", "ref", "pos", "ref_pos")
        out = staged(rows.mapInArrow(_passages(min_words, min_same), shape), "passages")
        new = out.where("around is null").select(*_PASSAGE)
        if unresolved_ones is None:
            unresolved_ones = out.where("around is not null").select("key", F.col("start_word").cast("int").alias("pos"), (F.col("equal_words") > 0).alias("free"))
        if rounds and new.isEmpty():
            break
        rounds.append(new)
        # a seed is known by its place in the reference that it had
        seeds = out.where("around is not null").select(F.col("ref").alias("r"), F.col("ref_start").alias("p"), "key", F.col("start_word").cast("int").alias("pos"), "around")
        refs = seeds.groupBy("r", "p").agg(F.min(owner).alias("o"), F.max("key").alias("last")).where("o.key <> last")
        refs = staged(refs.select("r", "p", F.col("o.key").alias("ref"), F.col("o.pos").alias("ref_pos"), F.col("o.around").alias("ref_around")), "refs")
        before, left = left, refs.count()
        if not left or (before is not None and left > 0.9 * before):
            break
        matches = seeds.join(small_side(refs, 1_000_000), ["r", "p"])
    if not unresolved_ones.isEmpty():
        for more in rounds[1:]:
            within = more.select(F.col("key").alias("k"), F.col("start_word").alias("a"), F.col("end_word").alias("b"))
            unresolved_ones = unresolved_ones.join(within, F.expr(f"key = k AND pos >= a AND pos + {K} <= b"), "left_anti")
        unresolved_ones = staged(unresolved_ones, "unresolved")
        rounds.append(_compared_with_all(unresolved_ones, found, min_words, min_same))
    found = functools.reduce(DataFrame.unionByName, rounds)
    if len(rounds) == 1:
        return found
    # a later round may find more of a passage: of spans one in the other the wider stays
    wider = Window.partitionBy("key").orderBy("start_word", F.desc("end_word"), "ref", "ref_start").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reached", F.max("end_word").over(wider)).where("reached is null OR reached < end_word").drop("reached")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_same: float = MIN_SAME) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) of ``min_words`` words or more that another document has too.

    Returns a row for each passage of each document but the one that it is kept in: doc_id, ref_doc_id (a document
    with the passage), start_word, end_word, ref_start, ref_end, equal_words. Words are as in ``kernels.NON_ALNUM``,
    lower-cased in ASCII; a word repeated on and on is no passage; at least ``min_same`` of the words on both sides are equal, in order. Of documents
    with equal texts the smallest doc_id keeps it, the others repeat it from end to end. Null and empty texts have
    no passages; a row with a null doc_id is reported under null, and is nobody's reference where another row has
    its text; repeated rows of a doc_id are one document. Extra columns are ignored; empty tables give an empty result.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", docs["doc_id"].cast("long"))
    rows = staged(docs.mapInArrow(_keys, "doc_id long, key long, n_words long").distinct(), "rows")
    owners = staged(rows.groupBy("key").agg(F.min("doc_id").alias("owner")), "owners")
    found = staged(passages_of_texts(docs, min_words, min_same), "passages")
    refs = found.join(owners.select(F.col("key").alias("ref"), F.col("owner").alias("ref_doc_id")), "ref")
    named = rows.join(owners, "key")
    out = named.where("doc_id <=> owner").join(refs, "key").where("NOT doc_id <=> ref_doc_id")
    span = ["start_word", "end_word", "ref_start", "ref_end", "equal_words"]
    copies = named.where(f"NOT doc_id <=> owner AND n_words >= {min_words}").select(
        "doc_id", F.col("owner").alias("ref_doc_id"), F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"),
        F.lit(0).cast("long").alias("ref_start"), F.col("n_words").alias("ref_end"), F.col("n_words").alias("equal_words"),
    )
    return out.select("doc_id", "ref_doc_id", *span).unionByName(copies)


def _cut(schema, taken):
    def run(batches):
        for batch in batches:
            out = batch.column("text").to_pylist()
            spans = batch.column(taken).to_pylist()
            todo = [i for i, s in enumerate(spans) if s and out[i]]
            for i in todo:
                data = out[i].encode("utf-8", "surrogatepass")
                w = kernels.words(pa.array([out[i]], pa.large_string()), kernels.NON_ALNUM)
                parts, at = [], 0
                for a, b in sorted((x["start_word"], x["end_word"]) for x in spans[i]):
                    begin, end = int(w.start[a]), int(w.start[b]) if b < len(w.start) else len(data)
                    if end > at:
                        parts.append(data[at : max(at, begin)])
                        at = end
                out[i] = b"".join([*parts, data[at:]]).decode("utf-8", "replace").strip()
            texts = pa.array(out, pa.string())
            keep = pa.array([not s or bool(t) for s, t in zip(spans, out)])
            columns = {f.name: batch.column(f.name) for f in batch.schema} | {"text": texts}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if not s else len(t) for s, t, n in zip(spans, out, columns["n_chars"].to_pylist())], pa.int64())
            names = [n for n in schema if n != taken]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(keep)

    return run


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that other documents keep, with all their columns.

    A document of which nothing is left goes; ``n_chars``, if there, follows the text. Texts are cut by their key,
    so equal texts are cut alike: of those only the row with the smallest doc_id is kept whole as a row.
    """
    names = docs.columns
    key, spans, least, many = (fresh(docs, n) for n in ("_key", "_spans", "_least", "_n"))
    found = passages_of_texts(plain(docs, "text")).groupBy("key").agg(F.collect_set(F.struct("start_word", "end_word")).alias(spans))
    found = staged(found.withColumnRenamed("key", key), "cuts")
    shape = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())])
    keyed = docs.mapInArrow(_with_key(key), shape)
    ids = keyed.groupBy(key).agg(F.min("doc_id").alias(least), F.count("*").alias(many)).where(F.col(many) > 1)
    firsts = staged(ids.select(key, least), "least")
    kept = keyed.join(small_side(firsts), key, "left").where(F.col(least).isNull() | F.col("doc_id").eqNullSafe(F.col(least))).drop(least)
    cut = kept.join(small_side(found, 200_000), key, "left")
    own = [F.col(f"`{c}`") for c in names]
    return cut.select(*own, spans).mapInArrow(_cut([*names, spans], spans), docs.schema)


def _with_key(name: str):
    def run(batches):
        for batch in batches:
            keys = pa.array([None if t is None else text_key(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return run
