"""Jaccard join with listed and salted shingles: the same components as with no list at all."""

import random

from meshlens.llm import jaccard_join


def test_list_and_salts_change_no_component(spark, monkeypatch):
    rng = random.Random(23)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for base in range(12):
        words = [f"w{base}x{rng.randrange(10**6)}" for _ in range(60)] + passage
        for k in range(6):
            copy = list(words)
            for at in rng.sample(range(60), k % 3 * 2):
                copy[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found(listed, salted):
        monkeypatch.setattr(jaccard_join, "FREQUENT_DF", listed)
        monkeypatch.setattr(jaccard_join, "SALTED_DF", salted)
        return sorted(map(tuple, jaccard_join.jaccard_classes(docs).collect()))

    plain = found(10**9, 10**9)
    assert len({c for _, _, c in plain}) < len(rows)
    assert found(2, 10**9) == plain
    assert found(2, 3) == plain
