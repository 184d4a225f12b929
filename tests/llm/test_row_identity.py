"""Dedup decides about rows, not ids; words of regular make don't collide; near copies below the threshold make no pairs."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from meshlens.llm import jaccard_join, kernels

WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int = 60) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_words_of_two_letters_in_a_regular_order_do_not_collide():
    order = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in order) for flip in (0, 1))
    for size in (32, 64, 65, 128, 1024):
        a, b, upper = kernels.words(pa.array([f"{x[:size]} z", f"{y[:size]} z", f"q {x[:size].upper()}"])).hash.reshape(-1, 2)
        assert a[0] != b[0] and a[1] == b[1] and upper[1] == a[0]
        exact = kernels.words(pa.array([x[:size], x[:size].upper()]), lower=False).hash
        assert exact[0] == a[0] and exact[0] != exact[1]


def test_near_duplicates_keep_one_row_a_group_and_every_unlike_row(spark):
    a, b, c = text(1), text(2), text(3)
    near = a.rsplit(" ", 2)[0] + " changed end"
    rows = [(1, a, 0, "x"), (2, a, 1, "x"), (2, b, 2, None), (None, a, 3, "x"), (None, c, 4, "x"), (None, c, 5, "x")]
    rows += [(7, "", 6, "x"), (8, "", 7, "x"), (9, None, 8, "x"), (9, None, 9, "x"), (4, near, 10, "x"), (5, b, 11, "x"), (5, b, 12, "x"), (3, " \n", 13, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, cls string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in out.collect())
    want = [(1, a), (2, b), (3, " \n"), (7, ""), (8, ""), (9, None), (9, None), (None, c)]
    assert got == sorted((i is None, i or 0, t is None, t or "") for i, t in want)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("percent", [75, 40])
def test_a_group_of_near_copies_below_the_threshold_makes_few_pairs(spark, monkeypatch, percent):
    rng = np.random.default_rng(5)
    base = [f"c{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(24, 4 if percent == 75 else 11, replace=False):
            words[at * 5 + 2] = f"own{i}x{at}"
        texts.append(" ".join(words))
    made, verified = [], jaccard_join._verified

    def counted(docs, classes, pairs, n, percent):
        made.append(pairs.count())
        return verified(docs, classes, pairs, n, percent)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs, percent=percent).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = list(range(150))
    for _ in range(150):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want))
    assert sum(made) < 150 * 150 / 4
