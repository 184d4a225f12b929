"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model is trained on all trusted documents but the held-out half. All its counts are Spark aggregations. Each n-gram of the model gets one additive value such that the log probability of a
text is the sum of the values of its n-grams:

    unigram w     ln p1(w) + ln g2(w)                        g: weight that a context leaves to the lower order
    bigram vw     ln p2(w|v) - ln g2(v) - ln p1(w) + ln g3(vw)
    trigram uvw   ln p3(w|uv) - ln g3(uv) - ln p2(w|v)

so that scoring is a sum per document. Tasks hold the most frequent words and n-grams, a bounded number; the
others are joined by hash, sharded where they are too many to broadcast. Unknown words
share their probability evenly. Values are whole micronats: sums don't depend on their order. Thresholds are quantiles of the perplexity of
the held-out trusted documents, by language, over all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import plain, small_side, staged

#: Words and trigrams seen less often in the training texts are unknown.
MIN_WORD_COUNT, MIN_TRIGRAM_COUNT = 2, 2
#: Most frequent words and n-grams that tasks hold, and bits that tell which others may be there; the rest is joined.
COMMON_WORDS, COMMON_NGRAMS, MOST_BITS = 500_000, 2_000_000, 1 << 27
#: Quantile of trusted perplexity up to which documents are kept; languages with fewer such documents use that of all.
QUANTILE, MIN_HELD_OUT = 0.995, 200
#: Texts of fewer words aren't judged.
MIN_WORDS = 20
BEGIN, END, UNKNOWN = (np.uint64(x) for x in (0x1B873593, 0x2C1B3C6D, 0x38495AB5))


def keys(*words: np.ndarray) -> np.ndarray:
    """Hash of n-grams given as columns of word hashes; 0 never occurs in practice and stands for no n-gram."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = kernels.mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def _within(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values are in the sorted ``table``, their places)."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def sequences(texts: pa.Array, common: np.ndarray, others: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all texts with two begins and an end each, text of each, words of each text).

    Known are the ``common`` words and what the lists ``others`` have.
    """
    w = kernels.words(texts)
    rare = np.unique(others.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    hashes = np.where(_within(w.hash, common)[0] | _within(w.hash, rare)[0], w.hash, UNKNOWN)
    counts = w.count
    doc = np.repeat(np.arange(len(counts)), counts + 3)
    start = np.concatenate([[0], np.cumsum(counts + 3)])[:-1]
    out = np.empty(len(doc), np.uint64)
    out[start], out[start + 1] = BEGIN, BEGIN
    out[start + counts + 2] = END
    out[np.arange(len(hashes)) + 3 * w.doc + 2] = hashes
    return out, doc, counts


def _word_counts(batches):
    for batch in batches:
        for _, texts in kernels.chunks(batch, "text"):
            word, n = np.unique(kernels.words(texts).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kernels.signed(word)), pa.array(n)], names=["word", "n"])


def _frequent(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent rows of ``counted`` (n), ``most`` at most, and the others."""
    size = F.floor(F.log2("n") * 8).cast("int")
    least, left = 1 << 30, most
    for k, n in sorted(map(tuple, counted.groupBy(size).count().collect()), reverse=True):  # some hundred at most
        if n > left:
            break
        least, left = k, left - n
    return counted.where(size >= least), counted.where(size < least)


def _rare_words(common):
    """Words of each text, by its hash, that aren't common."""

    def run(batches):
        for batch in batches:
            for first, texts in kernels.chunks(batch, "text"):
                w = kernels.words(texts)
                own = ~_within(w.hash, common.value)[0]
                text = batch.column("_text").slice(first, len(texts)).take(pa.array(w.doc[own]))
                yield pa.RecordBatch.from_arrays([text, pa.array(kernels.signed(w.hash[own]))], names=["_text", "word"])

    return run


def with_known(df: DataFrame, known: DataFrame):
    """(``df`` with the list ``_known`` of each text's known words that aren't common, broadcast of the common words)."""
    common, others = _frequent(known, COMMON_WORDS)
    words = common.select("word").toArrow()["word"].to_numpy()  # at most COMMON_WORDS
    shared = df.sparkSession.sparkContext.broadcast(np.sort(words.astype(np.int64).view(np.uint64)))
    if others.isEmpty():
        return df.withColumn("_known", F.lit(None).cast("array<long>")), shared
    df = df.withColumn("_text", F.xxhash64("text"))
    pairs = df.select("_text", "text").mapInArrow(_rare_words(shared), "_text long, word long").distinct()
    lists = pairs.join(others.select("word"), "word").groupBy("_text").agg(F.collect_list("word").alias("_known"))  # words of one text
    return df.join(staged(lists, "known"), "_text", "left").drop("_text"), shared


def _trigrams(common):
    """Distinct trigrams of a chunk."""

    def run(batches):
        for batch in batches:
            for first, texts in kernels.chunks(batch, "text"):
                x, doc, _ = sequences(texts, common.value, batch.column("_known").slice(first, len(texts)))
                at = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
                u, v, w = x[at], x[at + 1], x[at + 2]
                _, first_at, n = np.unique(keys(u, v, w), return_index=True, return_counts=True)
                parts = [pa.array(kernels.signed(p[first_at])) for p in (u, v, w)]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(n)], names=["u", "v", "w", "n"])

    return run


def _discounted(counts: DataFrame, *context: str) -> tuple[DataFrame, DataFrame]:
    """(``counts`` with ``q``, the discounted share of ``n`` in its context, and ``g``, what the context leaves; contexts).

    Discounts are the modified ones: D1 = 1 - 2Y n2/n1, D2 = 2 - 3Y n3/n2, D3 = 3 - 4Y n4/n3, Y = n1/(n1 + 2 n2).
    """
    n = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    n = {k: max(1, v or 0) for k, v in counts.agg(*n).first().asDict().items()}
    y = n["n1"] / (n["n1"] + 2 * n["n2"])
    d = [min(max(i - (i + 1) * y * n[f"n{i + 1}"] / n[f"n{i}"], 0.05), i - 0.05) for i in (1, 2, 3)]
    discount = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    total = counts.groupBy(*context).agg(F.sum("n").alias("total"), F.sum(discount).alias("left"))
    total = total.withColumn("g", F.coalesce(F.try_divide("left", "total"), F.lit(1.0))).drop("left")
    total = staged(total, "contexts")
    out = counts.join(total, list(context)) if context else counts.crossJoin(F.broadcast(total))  # the total is one row
    return out.withColumn("q", F.coalesce(F.try_divide(F.col("n") - discount, "total"), F.lit(0.0))).drop("total"), total


def _keyed(batches):
    """Key, x and n of n-grams given as u, v and w, of which shorter ones lack the first."""
    for batch in batches:
        words = [batch.column(c) for c in ("u", "v", "w")]
        u, v, w = (c.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for c in words)
        size = sum(c.is_valid().to_numpy(zero_copy_only=False).astype(np.int64) for c in words)
        key = np.choose(size - 1, [keys(w), keys(v, w), keys(u, v, w)])
        yield pa.RecordBatch.from_arrays([pa.array(kernels.signed(key)), batch.column("x"), batch.column("n")], names=["key", "x", "n"])


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values (key, value, n), known words (word, n)) of the model of ``texts`` (text)."""
    spark = texts.sparkSession
    texts = staged(texts.select("text").where("text is not null"), "trusted")
    words = texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    unknown = max(1, words.where(F.col("n") < MIN_WORD_COUNT).count())
    known = words.where(F.col("n") >= MIN_WORD_COUNT)
    marked, common = with_known(texts, known)
    three = marked.mapInArrow(_trigrams(common), "u long, v long, w long, n long").groupBy("u", "v", "w").agg(F.sum("n").alias("n"))
    three = staged(three, "trigrams")
    two = staged(three.groupBy("v", "w").agg(F.count("*").alias("n")), "bigrams")
    one = staged(two.groupBy("w").agg(F.count("*").alias("n")), "unigrams")
    unseen = int(kernels.signed(np.array([UNKNOWN]))[0])
    one = one.union(spark.createDataFrame([(unseen, 0)], "w long, n long")).groupBy("w").agg(F.sum("n").alias("n"))  # also without unknown words
    uniform = 1.0 / one.count()
    one, _ = _discounted(one)
    one = staged(one.select("w", "n", (F.col("q") + F.col("g") * uniform).alias("p1")), "p1")
    two, left2 = _discounted(two, "v")
    two = two.join(one.select("w", "p1"), "w").withColumn("p2", F.col("q") + F.col("g") * F.col("p1"))
    two = staged(two.select("v", "w", "n", "p2", (F.log("p2") - F.log("g") - F.log("p1")).alias("x")), "p2")
    three, left3 = _discounted(three, "u", "v")
    three = three.where(F.col("n") >= MIN_TRIGRAM_COUNT).join(two.select("v", "w", "p2"), ["v", "w"]).withColumn("p3", F.col("q") + F.col("g") * F.col("p2"))
    none = F.lit(None).cast("long")
    # an unknown word is one of as many as the texts have that are too rare
    rare = F.when(F.col("w") == unseen, F.lit(float(np.log(unknown)))).otherwise(0.0)
    parts = [
        one.select(none.alias("u"), none.alias("v"), "w", (F.log("p1") - rare).alias("x"), "n"),
        left2.select(none, none, "v", F.log("g"), "total"),
        two.select(none, "v", "w", "x", "n"),
        left3.select(none, "u", "v", F.log("g"), "total"),
        three.select("u", "v", "w", F.log("p3") - F.log("g") - F.log("p2"), "n"),
    ]
    values = parts[0]
    for part in parts[1:]:
        values = values.union(part)
    values = values.mapInArrow(_keyed, "key long, x double, n long").groupBy("key")
    values = values.agg(F.round(F.sum("x") * 1e6).cast("long").alias("value"), F.greatest(F.max("n"), F.lit(1)).alias("n"))
    return staged(values, "values"), known


def _bitmap(rest: DataFrame) -> np.ndarray:
    """Bits of the keys of ``rest``, ``MOST_BITS`` at most: n-grams without their bit need no join."""
    size = min(MOST_BITS, 1 << max(16, int(8 * rest.count()).bit_length()))
    word = F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(size - 1)), 6).alias("word")
    found = rest.groupBy(word).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _ngrams(common, frequent, bits):
    """A row for each document with the sum of its frequent n-grams, and one for each other n-gram that the model may have."""

    def run(batches):
        marks, (table, worth) = bits.value, frequent.value
        mask, row = np.uint64(max(64 * len(marks), 1) - 1), TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, texts in kernels.chunks(batch, "text"):
                x, doc, counts = sequences(texts, common.value, batch.column("_known").slice(first, len(texts)))
                every = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                if len(x) > 2:
                    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
                    every.append((keys(x[inner]), doc[inner]))
                    every.append((keys(x[inner - 1], x[inner]), doc[inner]))
                    third = inner[1:][doc[inner[1:] - 2] == doc[inner[1:]]] if len(inner) > 1 else inner[:0]
                    every.append((keys(x[third - 2], x[third - 1], x[third]), doc[third]))
                key, own = (np.concatenate(c) for c in zip(*every))
                hit, at = _within(key, table)
                held = np.zeros(len(counts), np.int64)
                np.add.at(held, own[hit], worth[at[hit]])
                key, own = key[~hit], own[~hit]
                if len(marks):
                    hit = (marks[((key & mask) >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1) == 1
                    key, own = key[hit], own[hit]
                else:
                    key, own = key[:0], own[:0]
                size, rows = len(counts), np.arange(len(counts)) + row
                part = batch.slice(first, size)
                columns = [part.column(c) for c in ("doc_id", "lang", "held_out")]
                spread = kernels.signed(kernels.mix(rows.astype(np.uint64)))  # rows of no n-gram go to any task
                columns = [pa.array(rows), *columns, pa.array(counts), pa.array(held), pa.array(spread), pa.array(np.zeros(size, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=_ROW)
                if len(key):
                    order = np.lexsort((key, own))
                    key, own = key[order], own[order]
                    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
                    n = np.diff(np.concatenate([start, [len(key)]]))
                    key, own = key[start], own[start]
                    empty = [pa.nulls(len(n), c.type) for c in columns[1:6]]
                    yield pa.RecordBatch.from_arrays([pa.array(own + row), *empty, pa.array(kernels.signed(key)), pa.array(n)], names=_ROW)
                row += size

    return run


_ROW = ["row", "doc_id", "lang", "held_out", "n_words", "held", "key", "n"]


def score(docs: DataFrame, values: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, lang, held_out, n_words, nats) of every row of ``docs`` (doc_id, lang, held_out, text)."""
    context = docs.sparkSession.sparkContext
    frequent, rest = _frequent(values, COMMON_NGRAMS)
    table = frequent.select("key", "value").toArrow()  # at most COMMON_NGRAMS
    key, worth = (table[c].to_numpy().astype(np.int64) for c in ("key", "value"))
    order = np.argsort(key.view(np.uint64))
    more = not rest.isEmpty()
    bits = _bitmap(rest) if more else np.zeros(0, np.uint64)
    docs, common = with_known(docs, known)
    shape = "row long, doc_id long, lang string, held_out boolean, n_words long, held long, key long, n long"
    rows = docs.mapInArrow(_ngrams(common, context.broadcast((key.view(np.uint64)[order], worth[order])), context.broadcast(bits)), shape)
    if not more:
        return rows.select("doc_id", "lang", "held_out", "n_words", (F.col("held") / 1e6).alias("nats"))
    rows = rows.join(small_side(rest.select("key", "value"), 3_000_000), "key", "left")
    micronats = F.coalesce("held", F.lit(0)) + F.col("n") * F.coalesce("value", F.lit(0))
    out = rows.groupBy("row").agg(*[F.max(c).alias(c) for c in _ROW[1:5]], (F.sum(micronats) / 1e6).alias("nats"))
    return out.drop("row")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Perplexity and verdict of every row of ``docs`` (doc_id, lang, text), given ``labels`` (doc_id, quality, toxic).

    Trusted are documents labelled quality 1 and not toxic; half of them (by the hash of their
    id) train the model, and the others set the thresholds. Returns doc_id, n_words,
    perplexity (null without words) and kept. Texts of fewer than ``MIN_WORDS`` words are kept if they have any; null
    and empty ones are not kept. Without trusted documents all others are kept. A null language is the language
    ''. Null ids are never trusted, repeated rows keep their rows, extra columns are ignored, an empty table
    gives an empty result.
    """
    docs = plain(docs, "doc_id", "lang", "text").withColumn("doc_id", docs["doc_id"].cast("long"))
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.expr("quality = 1 AND coalesce(toxic, 0) = 0")).alias("ok"))
    trusted = staged(trusted.where("ok AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")), "labels")
    sample = trusted.where("pmod(h, 2) = 0").select("doc_id")
    values, known = train(docs.join(small_side(sample), "doc_id", "left_semi"))
    held = trusted.where("pmod(h, 2) = 1").select("doc_id", F.lit(True).alias("held_out"))
    marked = docs.join(small_side(held), "doc_id", "left").select("doc_id", "lang", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    scored = score(marked, values, known).withColumn("perplexity", F.expr("CASE WHEN n_words > 0 THEN exp(least(-nats / (n_words + 1), 700D)) END"))
    scored = staged(scored.select("doc_id", "lang", "held_out", "n_words", "perplexity"), "scores")
    judged = scored.where(f"held_out AND n_words >= {MIN_WORDS}")
    bound = F.percentile_approx("perplexity", QUANTILE, 10_000)
    by_lang = staged(judged.groupBy("lang").agg(F.count("*").alias("m"), bound.alias("most")).where(F.col("m") >= MIN_HELD_OUT), "thresholds")
    overall = judged.agg(bound.alias("most_of_all"))
    out = scored.join(small_side(by_lang, 100_000), "lang", "left").crossJoin(F.broadcast(overall))  # one row
    within = F.coalesce(F.col("perplexity") <= F.coalesce("most", "most_of_all"), F.lit(True))
    kept = F.when(F.col("n_words") < MIN_WORDS, F.col("n_words") > 0).otherwise(within)
    return out.select("doc_id", "n_words", "perplexity", kept.alias("kept"))
