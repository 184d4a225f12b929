"""Sets that meet in many tiles: a pair is made in few of them, and none is lost."""

import itertools
import random

from pyspark.sql import functions as F

from meshlens.llm import jaccard_join


def test_meetings_of_near_copies(spark):
    rng = random.Random(5)
    tokens = {c: sorted(rng.sample(range(60), rng.choice([1, 2, 40, 50]))) for c in range(40)}
    rows = [(t, c, c, b, 7, 1 + t % 3, 100) for c, own in tokens.items() for t in own for b in (7, 8)]
    places = spark.createDataFrame(rows, "token long, cls long, component long, band int, own int, tiles int, n long")
    zero = F.lit(0).cast("long")
    places = jaccard_join._with_earlier(places).select("*", *[zero.alias(w) for w in jaccard_join._WORDS], F.array(zero).alias("map"))
    made = jaccard_join._met(places, 75).collect()
    expected = {(a, b) for a, b in itertools.combinations(tokens, 2) if set(tokens[a]) & set(tokens[b])}
    assert {(r.a, r.b) for r in made} == expected
    meetings = sum(len(set(tokens[a]) & set(tokens[b])) for a, b in expected)
    assert meetings > 10 * len(expected) and len(made) < 1.5 * len(expected)
