"""The language model is of all trusted documents outside the held-out half, however many words and n-grams it has."""

import random

import pytest
from pyspark.sql import functions as F

from meshlens.llm import perplexity
from tests.llm.test_operators import text


def test_all_trusted_documents_train(spark, monkeypatch):
    seen = []

    def train(texts):
        seen.append(texts.count())
        raise InterruptedError

    monkeypatch.setattr(perplexity, "train", train)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a b c").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    with pytest.raises(InterruptedError):
        perplexity.classify(docs, labels)
    assert seen == [docs.where("pmod(xxhash64(doc_id), 2) = 0").count()] and seen[0] > 5500


def test_joined_words_and_ngrams_score_as_held_ones(spark, monkeypatch):
    rng = random.Random(41)
    texts = spark.createDataFrame([(text(rng, 60),) for _ in range(60)], "text string")
    rows = [(i, "en", i % 2 == 0, text(rng, 50) + " never seen" * (i % 3)) for i in range(40)] + [(50, "en", False, ""), (51, None, False, rng.choice("xyz"))]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, lang string, held_out boolean, text string")
    whole = sorted(map(str, perplexity.score(docs, *perplexity.train(texts)).collect()))
    monkeypatch.setattr(perplexity, "COMMON_WORDS", 40)
    monkeypatch.setattr(perplexity, "COMMON_NGRAMS", 100)
    monkeypatch.setattr(perplexity, "MOST_BITS", 1 << 10)  # more rows to join, the same sums
    assert sorted(map(str, perplexity.score(docs, *perplexity.train(texts)).collect())) == whole and len(whole) == 43
