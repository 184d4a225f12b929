"""N-gram Jaccard self-join of whole documents.

Sets of word shingles of about the same size meet in size-banded tiles of shared prefix shingles. A
hashed bitmap of each set bounds the overlap from above (every differing bit is an element that one
side lacks); the pairs left are decided by the exact intersection of the sorted arrays.

How it scales: sets that are equal collapse to one class first, so exact copies cost one row each.
Shingles are ordered by hash, those of many sets after them by their counts, and a set's prefix of
``floor((1 - t) n) + 1`` shingles must meet that of any partner, so a bucket holds what shares a rare
shingle. One shuffle brings buckets together, those of frequent shingles salted. In each bucket all
members are tested against one pivot (linear in the bucket), pivots of one shingle with each other's first. Buckets
that still hold several components test their members against a second pivot, drawn by shingle, so that a group
of near copies that shares many shingles meets many pivots. Only buckets that are mixed even then go on to tiles,
salted by the bucket's size, where members of different components meet; their bitmaps grow with the band's sizes, so
that near copies just below the threshold are refused there, before any pair is made. A pair that meets in many buckets
is made in the first of them, and in no other of which its sets still know a common one before it. Pairs inside one component need no test, so a group of N near
copies never becomes N^2 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import fresh, plain, small_side, staged
from .components import connected_components

#: Shingles listed as shared (they go last in prefixes, the most shared ones at the very end): at most so many, each
#: counted in so many sets at least. The list only orders shingles; what it lacks costs candidates and loses nothing.
FREQUENT, FREQUENT_DF = 500_000, 8
#: From so many sets on a listed shingle's bucket is salted.
SALTED_DF = 64
#: A frequent shingle's bucket is dealt into so many, each with a pivot of its own.
SALTS = 64
#: A tile holds about so many members a side.
TILE = 1024
#: Earlier places of a set that each of its places in tiles knows, so that a pair is made in few of those where it meets.
EARLIER = 8
#: Bitmaps in tiles have about so many bits an element, up to so many 64-bit words; beyond, they bound less sharply.
TILE_BITS, TILE_WORDS = 16, 64
_WORDS = [f"b{i}" for i in range(8)]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle, an empty one none."""
    w = kernels.words(texts)
    at, hashes = kernels.ngrams(w, n)
    bounds = np.searchsorted(at, w.first)
    out = []
    for doc, count in enumerate(w.count):
        if count >= n:
            out.append(np.unique(hashes[bounds[doc] : bounds[doc + 1]]))
        elif count:
            whole = np.uint64(count)
            for h in w.hash[w.first[doc] : w.first[doc + 1]]:
                whole = kernels.mix(np.array([whole ^ h]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> np.uint64:
    """One key for equal sets."""
    return kernels.mix(np.array([kernels.mix(s ^ np.uint64(len(s))).sum(dtype=np.uint64)]))[0]


def bitmap(s: np.ndarray, log2: int = 9) -> np.ndarray:
    """Bytes of a bitmap of ``2 ** log2`` bits, set by the leading bits of the hashes."""
    bits = np.zeros(1 << log2, bool)
    bits[(s >> np.uint64(64 - log2)).astype(np.int64)] = True
    return np.packbits(bits)


def tile_words(band: int, percent: int) -> int:
    """64-bit words of the bitmaps that meet in tiles of a size band, a power of two."""
    need = TILE_BITS * (100.0 / percent) ** (band + 1) / 64
    return min(TILE_WORDS, 1 << max(0, int(np.ceil(np.log2(need)))))


def tile_bitmap(s: np.ndarray, words: int) -> np.ndarray:
    return bitmap(s, (64 * words).bit_length() - 1).view(np.int64)


def fine_bitmap(s: np.ndarray) -> bytes:
    """A bitmap of 2 to 4 bits an element, which rules out pairs that share less than some seven tenths."""
    return bitmap(s, max(3, int(len(s)).bit_length() + 1)).tobytes()


def differing_bits(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ; the longer one is first folded to the shorter one's length."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = np.packbits(np.unpackbits(y).reshape(-1, 2).any(axis=1))
    return int(np.bitwise_count(x ^ y).sum())


def _describe(n: int):
    def run(batches):
        for batch in batches:
            for row, texts in kernels.chunks(batch, "text"):
                sets = shingle_sets(texts, n)
                maps = np.array([bitmap(s) for s in sets], np.uint8).view(np.int64).reshape(-1, 8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(texts)), pa.array([len(s) for s in sets], pa.int64())]
                    + [pa.array([class_key(s).view(np.int64) if len(s) else None for s in sets], pa.int64())]
                    + [pa.array(maps[:, i]) for i in range(8)],
                    names=["doc_id", "n_shingles", "cls", *_WORDS],
                )

    return run


def _frequent(n: int):
    """Shingles that a task meets in two sets or more of some millions of shingles; equal sets count once there."""

    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 2
            return pa.RecordBatch.from_arrays([pa.array(kernels.signed(tokens[often])), pa.array(counts[often])], names=["token", "df"])

        for batch in batches:
            for _, texts in kernels.chunks(batch, "text"):
                for s in shingle_sets(texts, n):
                    if len(s) and (key := class_key(s)) not in seen:
                        seen.add(key)
                        held.append(s)
                        size += len(s)
                if size >= 4_000_000:
                    yield flush()
                    held, size, seen = [], 0, set()
        if size:
            yield flush()

    return run


def _prefixes(n: int, percent: int, frequent):
    def run(batches):
        (last, rank, salted_from), seen = frequent.value, set()
        for batch in batches:
            for _, texts in kernels.chunks(batch, "text"):
                tokens, keys, salts = [], [], []
                for s in shingle_sets(texts, n):
                    if len(s) and (key := class_key(s).view(np.int64)) not in seen:
                        seen.add(key)
                        size, plain_ones = len(s) * (100 - percent) // 100 + 1, len(s)
                        if len(last):
                            at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                            common = last[at] == s
                            order = np.argsort(rank[at[common]])
                            plain_ones = len(s) - int((rank[at[common]] >= salted_from).sum())
                            s = np.concatenate([s[~common], s[common][order]])
                        s = s[:size]
                        tokens.append(s)
                        salts.append(np.where(np.arange(len(s)) < plain_ones, 0, 1 + key % SALTS))
                        keys.append(np.full(len(s), key))
                if len(seen) > 1_000_000:
                    seen.clear()
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kernels.signed(np.concatenate(tokens))), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(keys))],
                        names=["token", "salt", "cls"],
                    )

    return run


def _members(batches):
    """Rows come sorted by (token, salt, cls): each group's first class is its pivot, the others follow it once each.

    Pivots have a row of their own only where the token is salted. A lone row is surely the only one of an
    unsalted group, so its test against the pivot is all that the group asks for. Nothing but the last row is held.
    """
    token = salt = pivot = before = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("token", "salt", "cls")]
        tokens, salts, classes = columns
        if not len(tokens):
            continue
        new = np.empty(len(tokens), bool)
        new[0] = (tokens[0], salts[0]) != (token, salt)
        new[1:] = (tokens[1:] != tokens[:-1]) | (salts[1:] != salts[:-1])
        again = np.empty(len(tokens), bool)
        again[0] = not new[0] and classes[0] == before
        again[1:] = ~new[1:] & (classes[1:] == classes[:-1])
        group = np.cumsum(new) - 1
        pivots = classes[np.flatnonzero(new)]
        if not new[0]:
            pivots, group = np.concatenate([[pivot], pivots]), group + 1
        own = pivots[group]
        keep = ~again & (~new | (salts > 0))
        lone = np.bincount(group[keep], minlength=len(pivots)) == 1
        lone[-1] = False  # groups at either end may go on in another batch
        lone[0] &= bool(new[0])
        lone = lone[group] & (salts == 0)
        token, salt, pivot, before = tokens[-1], salts[-1], own[-1], classes[-1]
        columns = {"token": tokens, "salt": salts, "pivot": own, "cls": classes, "lone": lone}
        yield pa.RecordBatch.from_pydict({c: pa.array(x[keep]) for c, x in columns.items()})


def _sets(n: int, fine: bool):
    """(cls, n, data): the fine bitmap of each set, or its sorted shingles."""

    def run(batches):
        for batch in batches:
            for _, texts in kernels.chunks(batch, "text"):
                sets = [s for s in shingle_sets(texts, n) if len(s)]
                data = [fine_bitmap(s) if fine else s.tobytes() for s in sets]
                keys = [class_key(s).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(data, pa.binary())],
                    names=["cls", "n", "data"],
                )

    return run


def _tile_maps(n: int, percent: int):
    """(cls, own, next): bitmaps for the tiles of each set's own size band and of the next one."""

    def run(batches):
        for batch in batches:
            for _, texts in kernels.chunks(batch, "text"):
                sets = [s for s in shingle_sets(texts, n) if len(s)]
                bands = [_band(len(s), percent) for s in sets]
                columns = [pa.array([class_key(s).view(np.int64) for s in sets], pa.int64())]
                for above in (0, 1):
                    maps = [tile_bitmap(s, tile_words(band + above, percent)) for s, band in zip(sets, bands)]
                    columns.append(pa.array(maps, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "own_map", "next_map"])

    return run


def _band(n: int, percent: int) -> int:
    """Sets that may link are in one band or in neighbouring ones."""
    return int(np.log(float(n)) / np.log(100.0 / percent) + 1e-9)


def _bounded(na: int, nb: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The fine bitmaps allow the pair."""
    return (100 + percent) * (na + nb - differing_bits(a, b)) >= 2 * percent * (na + nb)


def _linked(na: int, nb: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact intersection of the sorted arrays reaches the threshold."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return (100 + percent) * common >= percent * (na + nb)


def _filter(test, percent: int):
    def run(batches):
        for batch in batches:
            a, b, *given = (batch.column(c) for c in ("a", "b", "na", "nb", "da", "db"))
            sizes = [c.to_pylist() for c in given[:2]]
            data = ([np.frombuffer(x.as_buffer(), np.uint8) for x in c] for c in given[2:])
            keep = pa.array([test(*x, percent) for x in zip(*sizes, *data)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _may_link(x: str, y: str, percent: int) -> Column:
    """Sizes and bitmaps allow the pair: the overlap's upper bound reaches what the threshold needs."""
    differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in _WORDS), F.lit(0))
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    smaller, larger = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (100 * smaller >= percent * larger) & ((100 + percent) * (total - differ) >= 2 * percent * total)


def _may_link_finely(x: str, y: str, percent: int) -> Column:
    """The tile bitmaps allow the pair."""
    differ = F.aggregate(F.zip_with(f"{x}.map", f"{y}.map", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _with_earlier(places: DataFrame) -> DataFrame:
    """``places`` (token, cls, band) with the tokens of the places next before each; a set's places in a band are at most its prefix."""
    nearest = Window.partitionBy("cls", "band").orderBy("token").rowsBetween(-EARLIER, -1)
    return places.withColumn("earlier", F.collect_list("token").over(nearest))


def _met(places: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in a tile and may link, of each at least its first meeting."""
    x = places.where("band = own").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    y = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.salt") == F.col("y.salt"))
    once = (F.col("x.band") > F.col("y.own")) | (F.col("x.cls") < F.col("y.cls"))
    apart = (F.col("x.component") != F.col("y.component")) & once
    first = ~F.arrays_overlap("x.earlier", "y.earlier")  # else the pair meets there too; at its first token it has none
    pairs = x.alias("x").join(y.alias("y"), same & apart & _may_link("x", "y", percent) & first & _may_link_finely("x", "y", percent))
    return pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def _sets_of(docs: DataFrame, needed: DataFrame, task, shape: str) -> DataFrame:
    """What ``task`` makes of the set of each class of ``needed`` (cls, rep), once. Sets that only rows without an id have are looked for among these."""
    rows = docs.join(small_side(needed.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    if not needed.where("rep IS NULL").isEmpty():
        rows = rows.unionByName(docs.where("doc_id IS NULL"))
    found = rows.mapInArrow(task, shape)
    return found.join(small_side(needed.select("cls")), "cls", "left_semi").dropDuplicates(["cls"])


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link: finer bitmaps bound them, then whole sets decide."""
    pairs = staged(pairs, "pairs")
    for fine, test in ((True, _bounded), (False, _linked)):
        needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(classes.select("cls", "rep"), "cls")
        needed = staged(needed, "needed")
        data = _sets_of(docs, needed, _sets(n, fine), "cls long, n long, data binary")  # its exchange by cls serves both sides
        for side in "ab":
            pairs = pairs.join(data.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("data").alias(f"d{side}")), side)
        pairs = staged(pairs.mapInArrow(_filter(test, percent), "a long, b long"), "links")
    return pairs


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Link documents whose sets of ``n``-word shingles have a Jaccard similarity of ``percent`` or more.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored. Returns one row per row of
    ``docs``: doc_id, n_shingles (set size) and component_id, the smallest doc_id that links reach.
    Null or empty texts have an empty set, link with nothing and are their own component. Shorter texts
    than ``n`` words are one shingle. Rows with a null doc_id link and bridge as others
    do and take the smallest doc_id of their component (null if no row of it has one). Repeated rows with one doc_id each keep
    their row. An empty table gives an empty result.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_shingles", "cls", *_WORDS)])
    described = staged(docs.mapInArrow(_describe(n), shape), "sets")
    classes = described.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(b).alias(b) for b in _WORDS]
    )
    classes = staged(classes, "classes")

    often = docs.mapInArrow(_frequent(n), "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    often = often.where(F.col("df") >= FREQUENT_DF).orderBy(F.desc("df"), "token").limit(FREQUENT)
    listed = often.toArrow()  # at most FREQUENT rows of two numbers
    token, df = listed.column("token").to_numpy().astype(np.int64).view(np.uint64), listed.column("df").to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, df))] = np.arange(len(token))
    by_token = np.argsort(token)
    frequent = docs.sparkSession.sparkContext.broadcast((token[by_token], rank[by_token], int((df < SALTED_DF).sum())))

    prefixes = docs.mapInArrow(_prefixes(n, percent, frequent), "token long, salt int, cls long")
    prefixes = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "cls")
    members = staged(prefixes.mapInArrow(_members, "token long, salt int, pivot long, cls long, lone boolean"), "members")
    salted = members.where("salt > 0 AND cls = pivot").select("token", F.col("pivot").alias("b"))
    heads = salted.join(salted.groupBy("token").agg(F.min("b").alias("a")), "token").where("a <> b").select("a", "b")

    shapes = classes.select("cls", "n", *_WORDS)

    def possible(pairs: DataFrame) -> DataFrame:
        found = pairs.join(shapes.alias("x"), F.col("x.cls") == F.col("a")).join(shapes.alias("y"), F.col("y.cls") == F.col("b"))
        return found.where(_may_link("x", "y", percent)).select("a", "b")

    pairs = members.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    first = possible(pairs.union(heads).distinct())
    links = _verified(docs, classes, first, n, percent)
    joined = connected_components(links)

    def still_mixed(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of tokens with several components, and per such token its tiles and a pivot of its own."""
        component = F.coalesce("component", "cls").alias("component")
        rest = rest.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", component)
        rest = staged(rest, "rest")
        lead = F.min(F.struct(F.xxhash64("token", "cls").alias("order"), "cls", "component")).alias("lead")
        mixed = rest.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), lead)
        tiles = F.ceil(F.col("size") / TILE).cast("int").alias("tiles")
        mixed = mixed.where("lo <> hi").select("token", tiles, F.col("lead.cls").alias("lead"), F.col("lead.component").alias("lead_component"))
        mixed = staged(mixed, "mixed")
        return rest, mixed

    rest, mixed = still_mixed(members.where("NOT lone"))
    if not mixed.isEmpty():
        led = rest.join(small_side(mixed), "token").where("component <> lead_component")
        led = led.select(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b")).distinct()
        links = links.union(_verified(docs, classes, possible(led), n, percent))
        joined = connected_components(links)
        rest, mixed = still_mixed(rest.select("token", "cls"))
    if not mixed.isEmpty():
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
        tile = rest.join(small_side(mixed), "token").select("token", "cls", "component", "tiles").join(classes.select("cls", "n"), "cls")
        tile = tile.select("token", "cls", "component", "tiles", band.alias("own"))
        tile = staged(tile.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1))), "tile")
        ends = F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("band") == F.col("own")).alias("owned")
        live = staged(tile.groupBy("token", "band").agg(*ends).where("lo <> hi AND owned").select("token", "band"), "live")
        tile = staged(tile.join(small_side(live), ["token", "band"], "left_semi"), "places")  # where two components meet
        needed = staged(tile.select("cls").distinct().join(classes.select("cls", "rep"), "cls"), "needed")
        tile = staged(_with_earlier(tile), "earlier")
        maps = _sets_of(docs, needed, _tile_maps(n, percent), "cls long, own_map array<long>, next_map array<long>")
        tile = tile.join(staged(maps.join(shapes, "cls"), "maps"), "cls")
        own = F.col("band") == F.col("own")
        y = tile.withColumn("map", F.when(own, F.col("own_map")).otherwise(F.col("next_map"))).drop("own_map", "next_map")
        links = links.union(_verified(docs, classes, _met(y, percent).distinct(), n, percent))
        joined = connected_components(links)

    named = joined.join(classes.select(F.col("cls").alias("node"), "rep"), "node").select("node", "component", "rep")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = staged(named.join(smallest, "component").select(F.col("node").alias("cls"), "component_id"), "ids")
    out = described.select("doc_id", "n_shingles", "cls").join(small_side(ids), "cls", "left")
    out = out.join(small_side(classes.select("cls", "rep")), "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group that links reach, in all its columns.

    The row with the smallest doc_id stays; a null doc_id comes after all others, and of rows alike in both any one
    stays. Groups are of rows, not of ids: repeated rows and rows with null ids are decided one by one, and a doc_id
    with two unlike texts keeps both. Null, empty and wordless texts are linked with nothing and all stay. Very long
    texts are hashed whole, each in a chunk of its own. Extra columns, whatever their names, pass through; an empty
    table stays empty.
    """
    names, row = docs.columns, fresh(docs, "_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    classes = jaccard_classes(rows.select(F.col(row).alias("doc_id"), "text"), n, percent)
    members = staged(classes.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).join(ids, "row"), "members")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first")
    groups = members.groupBy("group").agg(first, F.count("*").alias("size")).where("size > 1")
    groups = staged(groups.select("group", F.col("first.row").alias("kept")), "groups")
    others = members.join(small_side(groups), "group").where("row <> kept").select(F.col("row").alias(row))
    return rows.join(small_side(staged(others, "others")), row, "left_anti").select(*[F.col(f"`{c}`") for c in names])
