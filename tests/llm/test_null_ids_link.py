"""Rows without an id link documents, and are linked, as any other."""

from meshlens.llm import jaccard_join

WORDS = [f"w{i}" for i in range(60)]


def test_a_row_without_id_bridges(spark):
    a = WORDS[:40]
    b, c = a[4:] + WORDS[40:44], a[8:] + WORDS[40:48]

    def similar(x, y):
        p, q = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        return 100 * len(p & q) / len(p | q)

    assert similar(a, b) >= 75 and similar(b, c) >= 75 and similar(a, c) < 75
    d = [f"d{i}" for i in range(30)]
    rows = [(1, a), (None, b), (3, c), (None, d), (None, d[1:]), (None, ["alone"]), (9, ["alone"]), (None, [])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()), key=str)
    want = [(1, 36, 1), (None, 36, 1), (3, 36, 1), (None, 26, None), (None, 25, None), (None, 1, 9), (9, 1, 9), (None, 0, None)]
    assert got == sorted(want, key=str)
