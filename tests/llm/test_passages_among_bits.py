"""Passages whose seeds have their references in many texts that hold bits of them; recall against the planted ones."""

import random

from meshlens.llm import substrings


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.doc_id, r.start_word, r.end_word) for r in substrings.repeated_passages(docs).collect()]


def test_two_texts_among_bits_of_their_passage(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(60)]
    texts = [" ".join([*[word() for _ in range(20)], *shared, *[word() for _ in range(20)]]) for _ in range(2)]
    for i in range(120):
        a = rng.randrange(48)
        texts.append(" ".join([*[word() for _ in range(15)], *shared[a : a + 13], *[word() for _ in range(15)]]))
    got = spans(spark, texts)
    assert len(got) == 1 and got[0][0] in (0, 1) and abs(got[0][1] - 20) <= 1 and abs(got[0][2] - 80) <= 1


def test_recall_among_bits_and_edits(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    fill = lambda n: [word() for _ in range(n)]
    texts, planted = [], []
    for i in range(40):
        shared, holders = fill(rng.randrange(60, 120)), []
        for _ in range(rng.randrange(2, 5)):
            copy = [word() if rng.random() < 0.02 else w for w in shared]
            lead = rng.randrange(10, 40)
            holders.append((len(texts), lead, lead + len(copy)))
            texts.append(" ".join([*fill(lead), *copy, *fill(20)]))
        planted.append(holders)
        for _ in range(30):
            a = rng.randrange(len(shared) - 13)
            texts.append(" ".join([*fill(12), *shared[a : a + 13], *fill(12)]))
    got = spans(spark, texts)
    hit = lambda d, a, b: sum(max(0, min(b, y) - max(a, x)) for t, x, y in got if t == d) >= 0.8 * (b - a)
    found = sum(min(len(h) - 1, sum(hit(*x) for x in h)) for h in planted)
    assert found >= 0.9 * sum(len(h) - 1 for h in planted)
    assert all(sum(hit(*x) for x in h) < len(h) for h in planted)  # one of each group keeps it
    within = {d: (a, b) for h in planted for d, a, b in h}
    assert all(d in within and x >= within[d][0] - 1 and y <= within[d][1] + 1 for d, x, y in got)


def test_overlapping_pieces_count_once():
    pieces = [(0, 40, 5, 45, 30, 1), (20, 60, 0, 40, 30, 2)]
    assert substrings.merged(pieces, 50, 0.6) == [(1, 0, 60, 5, 45, 40)] and substrings.merged(pieces, 50, 0.75) == []


def test_passage_whose_references_stay_unresolved(spark):
    """Texts with bits of it have long unresolved runs themselves, so they are its seeds' references in every round."""
    rng = random.Random(3)
    fill = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = fill(60)
    texts = [" ".join([*fill(20), *shared, *fill(20)]) for _ in range(2)]
    for _ in range(60):
        other = fill(30)
        for _ in range(2):
            a = rng.randrange(48)
            texts.append(" ".join([*fill(15), *shared[a : a + 13], *other, *fill(15)]))
    got = spans(spark, texts)
    assert len(got) == 1 and got[0][0] in (0, 1) and abs(got[0][1] - 20) <= 1 and abs(got[0][2] - 80) <= 1


def test_spans_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted({(int(k), int(p)) for k, p in zip(rng.integers(0, 5, 300), rng.integers(0, 200, 300))})
    seeds = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, len(rows))]
    for low, high in ((21, 50), (0, 30)):
        want = sum(j[0] == i[0] and low <= j[1] - i[1] <= high for i in rows for j in rows if j >= i)
        found = []
        for size in (1, 7, 1000):
            table = pa.table({"seed": pa.array(seeds), "key": pa.array([r[0] for r in rows]), "pos": pa.array([r[1] for r in rows], pa.int32())})
            got = [x for b in substrings._spans(low, high)(iter(table.to_batches(max_chunksize=size))) for x in zip(*(c.to_pylist() for c in b.columns))]
            assert len(got) == want
            found.append(sorted(got))
        assert found[0] == found[1] == found[2]


def test_pairs_hold_a_free_seed_and_are_a_row_each(spark, monkeypatch):
    """Texts that share but a line with all others, beside a passage that is found, are compared over the line's free seeds alone."""
    rng = random.Random(6)
    fill = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, line = fill(90), fill(40)
    texts = [" ".join([*fill(10), *shared, *fill(10)]) for _ in range(50)]
    texts += [" ".join([*fill(10), *shared, *fill(5), *shared[:20], *fill(20), *shared[30:50], *fill(20)]) for _ in range(50)]
    tail = fill(30)
    texts += [" ".join([*fill(20), *line, *(tail if i < 2 else fill(30)), *fill(20)]) for i in range(45)]
    made, whole = {}, substrings.staged

    def staged(df, name):
        made[name] = out = whole(df, name)
        return out

    monkeypatch.setattr(substrings, "staged", staged)
    got = spans(spark, texts)
    assert len({d for d, a, b in got if d < 100 and b - a >= 85}) == 99
    assert [b - a for d, a, b in got if d >= 100] == [70]
    keys = [substrings.text_key(t) for t in texts]
    lines = sorted(keys[100:])
    pairs = {(r.key, r.ref) for r in made["pairs"].collect()}
    assert {(a, b) for a in lines for b in lines if b < a} >= {p for p in pairs if p[0] in lines}
    assert not any(k in keys[:50] for k, _ in pairs)  # all that these share lies in their passage
    assert made["with-all"].count() <= len(pairs)


def test_spans_of_a_repeated_line_are_made_once():
    import pyarrow as pa

    seeds = [11, 22, 33, 44] * 200
    table = pa.table({"seed": pa.array(seeds), "key": pa.array([5] * 800), "pos": pa.array(range(0, 8000, 10), pa.int32())})
    got = [x for b in substrings._spans(21, 50)(iter(table.to_batches())) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert len({x[0] for x in got}) == 12 and len(got) < 20
    parts = [x for b in substrings._spans(21, 50)(iter(table.to_batches(max_chunksize=9))) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(parts) == sorted(got)


def test_wider_and_closer_spans_imply_every_pair():
    """The spans that the join leaves a pair with are some wherever any span is common."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    for _ in range(50):
        rows = []
        for key in (1, 2):
            pos = np.sort(rng.choice(300, 60, replace=False))
            rows += [(int(s), key, int(p)) for s, p in zip(rng.integers(0, 8, 60), pos)]
        table = pa.table({"seed": pa.array([r[0] for r in rows]), "key": pa.array([r[1] for r in rows]), "pos": pa.array([r[2] for r in rows], pa.int32()), "free": pa.array([bool(x) for x in rng.random(120) < 0.3])})
        found = [{x for b in substrings._spans(21, high)(iter(table.slice(60 * k, 60).to_batches(max_chunksize=17))) for x in zip(*(c.to_pylist() for c in b.columns))} for k, high in ((0, 50), (1, 116))]
        common = {a[0] for a in found[0]} & {b[0] for b in found[1]}
        kept = [1 for a in found[0] for b in found[1] if a[0] == b[0] and (a[2] != b[2] or not b[2]) and (a[3] != b[3] or not b[3])]
        assert bool(kept) == bool(common)


def test_only_spans_that_make_a_pair_meet(spark, monkeypatch):
    """A line that many texts have gives many spans; all but the widest ones are implied and go before the texts are joined."""
    rng = random.Random(8)
    fill = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = fill(40)
    texts = [" ".join([*fill(20), *line, *fill(20)]) for _ in range(45)]
    made, whole = {}, substrings.staged

    def staged(df, name):
        made[name] = out = whole(df, name)
        return out

    monkeypatch.setattr(substrings, "staged", staged)
    monkeypatch.setattr(substrings, "SPAN_TILE", 10)  # tiles make no difference
    assert spans(spark, texts) == []
    own, keys = {}, sorted(substrings.text_key(t) for t in texts)
    for r in made["own"].collect():
        own.setdefault(r.span, []).append(r)
    other = made["other"].collect()
    meets = lambda x, r: r.ref < x.key and (x.wider != r.w or r.w == 0) and (x.closer != r.c or r.c == 0)
    assert other and all(any(meets(x, r) for x in own.get(r.span, [])) for r in other)
    assert {(r.key, r.ref) for r in made["pairs"].collect()} == {(a, b) for a in keys for b in keys if b < a and a != keys[0]}
