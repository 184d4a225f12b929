"""Source divergence, chat formatting and centroid clustering against brute force, on awkward rows too."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from meshlens.llm import chat, divergence, lloyd

DOCUMENTS = "doc_id long, text string, lang string, source string, term string, n long, kept double"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audited(rows, min_docs, ranks):
    """Rows of the audit, every term of every pair in full."""
    docs, places, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang or "", source or ""))
        docs[lang or ""].update(set(found))
        places[lang or "", source or ""].update(found)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        count = {s: places[lang, s] for g, s in groups if g == lang}
        count[None] = sum(count.values(), Counter())
        total = {s: sum(c[t] for t in kept) for s, c in count.items()}

        def p(s, t):
            return 1 + 10**9 * (count[s][t] + 2) // (total[s] + 2 * len(kept))

        def f(a, b, t):
            return (p(a, t) - p(b, t)) ** 2 // (p(a, t) + p(b, t))

        pairs = sorted((-sum(f(source, s, t) for t in kept), s.encode()) for s in count if s not in (None, source))
        apart = sorted((-f(source, None, t), t.encode()) for t in kept if count[source][t] and p(source, t) > p(None, t))
        for part, found in (("pair", pairs), ("term", apart[:ranks])):
            out |= {(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("wa", "Ée", "ｘ", "zz", "Mo") for b in "abcdefgh"]
    rows = []
    for i in range(160):
        source = rng.choice(["s0", "s0", "s0", "s1", "S1", "ünder", None])
        words = rng.choices(vocabulary[: rng.choice([8, 20, 40])], k=rng.randrange(60))
        rows.append((i, rng.choice([" ", "1", "-", "\n"]).join(words), rng.choice(["en", "en", "de", None]), source))
    rows += [(900, None, "en", "silent"), (901, "", "xx", "alone"), (902, "only here", "yy", "a"), (902, "only here", "yy", "a"), (None, "wa" * 3, "yy", None)]
    return rows + rows[:10]


def test_audit_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], DOCUMENTS).repartition(5)
    want = audited(rows, 4, 3)
    assert {x[2] for x in want} == {"pair", "term"} and any(x[4] == 0 for x in want)
    got = list(map(tuple, divergence.audit(df, min_docs=4, ranks=3).collect()))
    assert len(got) == len(want) and set(got) == want


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], DOCUMENTS)
    assert divergence.audit(df).count() == 0


def test_tables_and_chunks_change_nothing(monkeypatch):
    import pyarrow as pa

    texts = ["ab Cd ef éé " * 50, None, "", "x" * 999 + " y", "ab cd"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(["a", "b", None, "a", "b"]), pa.array(texts)], names=["lang", "source", "text"])

    def sums():
        out = Counter()
        for b in divergence._counted([batch, batch]):
            for lang, source, term, n, docs in zip(*[c.to_pylist() for c in b.columns]):
                out[lang, source, term, "n"] += n
                out[lang, source, term, "docs"] += docs
        return +out, {k[:3] for k in out}

    want = sums()
    monkeypatch.setattr(divergence, "TABLE", 3)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    assert sums() == want and want[0]["en", "a", "ab", "n"] == 100 and ("en", "", None) in want[1]


def test_prices_of_large_counts(spark):
    from pyspark.sql import functions as F

    n, total, kept = 2_500_000_000_000, 50_000_000_000_000, 90_000_000
    got = spark.range(1).select(divergence.price(F.lit(n), F.lit(total), F.lit(kept)), divergence.gap(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long"))).first()
    assert tuple(got) == (1 + 10**9 * (n + 2) // (total + 2 * kept), 10**18 // (10**9 + 2))


TURNS = "conv_id long, turn long, role string, text string, example int, whole string"


def conversation(rng, size):
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", " ", "\n", "é", "\U0001f600", "$1"]
    roles = ["user", "assistant", "system", "[INST]", "</s>user", "", None, "\\"]
    return [(i, rng.choice(roles[:3] if rng.random() < 0.8 else roles), None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.randrange(12)))) for i in range(size)]


def test_chat_examples_and_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, *t) for c in range(40) for t in conversation(rng, rng.randrange(1, 9))]
    rows += [(50, 3, "assistant", "same"), (50, 3, "assistant", "same"), (50, None, "user", "first"), (None, 0, "user", "of null"), (None, 1, "assistant", "x")]
    rows += [(60, i, "assistant" if i % 2 else "user", "long <s> " * 40) for i in range(200)]
    turns = defaultdict(list)
    for c, n, role, text in rows:
        turns[c].append((-1 if n is None else n, role or "", text or ""))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(7)
    examples = chat.expand(df)
    found = {(r.conv_id, r.example): r for r in examples.collect()}
    for c, own in turns.items():
        own.sort()
        replies = [i for i, t in enumerate(own) if t[1] == "assistant"]
        ends = replies + [len(own) - 1] * (not replies or replies[-1] != len(own) - 1)
        assert sorted(e for k, e in found if k == c) == list(range(len(ends)))
        for e, last in enumerate(ends):
            r = found[c, e]
            parts = r.text[len(chat.BEGIN) :].split(chat.END)[:-1]
            back = [tuple(re.sub(r"(?s)\\(.)", r"\1", y) for y in x[len(chat.HEAD) :].split(chat.BODY)) for x in parts]
            assert back == [t[1:] for t in own[: last + 1]] and r.whole == (last == len(own) - 1)
            loss = None if r.loss_start is None else re.sub(r"(?s)\\(.)", r"\1", r.text[r.loss_start : r.loss_end])
            assert loss == (own[last][2] if e < len(replies) else None)
    for r in chat.digests(examples).collect():
        own = turns[r.conv_id]
        loss = "".join(t for _, role, t in own if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in own)
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (said, loss))
        assert r.formatted_chars == sum(len(x.text) for (c, _), x in found.items() if c == r.conv_id)


def test_chat_of_nothing(spark):
    assert chat.digests(chat.expand(spark.createDataFrame([], TURNS))).count() == 0


def lloyds(rows, k, rounds, dim):
    """Plain Lloyd in whole numbers, every distance anew."""
    vectors = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"3:{v[0]}".encode()).hexdigest(), v[1]))
    centroids = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in vectors]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(vectors, owners) if o == j]
            if own:
                centroids[j] = tuple(sum(x) // len(own) for x in zip(*own))
    found = [(i, *nearest(v)[::-1]) for i, v in vectors]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def points(rng, n, dim, spread):
    means = [[rng.uniform(-spread, spread) for _ in range(dim)] for _ in range(5)]
    return [[x + rng.gauss(0, 1) for x in rng.choice(means)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.5, 3.0, 2e4])
def test_clusters_equal_plain_lloyd(spark, spread):
    rng = random.Random(9)
    dim = 6
    odd = [(500, None), (501, [1.0] * 5), (502, [1.0] * 5 + [None]), (503, [1.0] * 5 + [float("nan")]), (504, [float("-inf")] * 6), (505, [])]
    rows = [*enumerate(points(rng, 120, dim, spread)), *odd, (None, [0.25] * dim), (7, [0.5] * dim), (7, [0.5] * dim), (7, [-0.0001] * dim)]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, owner string").repartition(3)
    for rounds in (0, 4):
        got = sorted(map(tuple, lloyd.cluster(df, k=6, rounds=rounds, dim=dim).collect()), key=str)
        assert got == lloyds(rows, 6, rounds, dim)


def test_few_and_equal_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    same = [(i, [0.5] * 64) for i in range(20)]
    assert {(r.cluster, r.distance) for r in lloyd.cluster(spark.createDataFrame(same, shape)).collect()} == {(0, 0)}
    three = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], shape)
    assert sorted(r.cluster for r in lloyd.cluster(three).collect()) == [0, 1, 2]
    assert lloyd.cluster(spark.createDataFrame([], shape)).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_chat_formatting", "op13_centroid_clustering"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    from meshlens.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = queries.queries()[name](spark, d), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)
