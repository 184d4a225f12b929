"""Each operator against brute force or an exact round trip, and on awkward rows."""

import base64
import hashlib
import html as entities
import random
import re
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshlens.llm import decontaminate, html_extract, jaccard_join, kernels, licenses, packing, perplexity, quality_rules, substrings, token_counts, warc
from meshlens.llm.components import connected_components

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text) with further columns, some named as the operators' own."""
    return spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t), "x", 1.5) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, key string, token double",
    )


def awkward(spark):
    long = " ".join(WORDS) * 30
    return documents(spark, [(1, None), (2, ""), (3, "one"), (4, long), (4, long), (None, "a b c d e f"), (5, "\n\t "), (6, "ÄÖ \U0001f600 x")])


BENCHMARK = "item_id long, text string"
OPERATORS = {
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "tokens": lambda s, d: token_counts.count_tokens(d, PIECES),
    "jaccard": lambda s, d: jaccard_join.jaccard_classes(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "classifier": lambda s, d: perplexity.classify(d, s.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_row(spark, name):
    docs = awkward(spark)
    assert OPERATORS[name](spark, docs).count() == docs.count()
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_awkward_rows_elsewhere(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(WORDS[:30]))], BENCHMARK)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(4, 3)}
    assert decontaminate.leaks(docs.limit(0), bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert substrings.repeated_passages(docs).count() == substrings.repeated_passages(docs.limit(0)).count() == 0
    assert {r.doc_id for r in packing.pack(docs, BPE).collect()} == {1, 2, 3, 4, 5, 6, None}
    assert packing.pack(docs.limit(0), BPE).count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "key")
    assert html_extract.extract_text(pages).count() == warc.round_trip(pages).count() == 8
    assert html_extract.extract_text(pages.limit(0)).count() == warc.round_trip(pages.limit(0)).count() == 0


def test_licenses(spark):
    rows = ["Under the terms of the MIT License", "licensed under the GNU Lesser General Public License version 3", "cc by cc-by", "submit license", None]
    out = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, list(enumerate(rows)))).collect()}
    assert (out[0].n_base, out[0].first_word, out[0].base_labels, out[0].score) == (1, 5, "mit", 1.0)
    assert (out[1].base_labels, out[1].labels) == ("", "notice:gpl") and out[1].score == 1.0
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].n_words) == (2, 0, 2, 4)
    assert (out[3].n_base, out[3].first_word, out[4].n_words) == (0, None, 0)


def test_license_base_places_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "gnu general public license apache mit cc by x é".split()
    rows = [(i, rng.choice(["", "\n", "-"]).join(rng.choice(vocabulary) + rng.choice(" -,\n") for _ in range(rng.randrange(40)))) for i in range(200)]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        found = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in found]
        assert got[i] == (len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))), t


def test_token_counts_are_the_tokenizers():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    scores = dict(token_counts.vocabulary(PIECES))
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = scores[p.piece]
    exact, count = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), token_counts.counter(PIECES)
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("the and ofingtioneraäé日\n  .,XYZ🎉") for _ in range(rng.randrange(60)))
        assert count(t) == len(exact.encode(t)), repr(t)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        k = rng.randrange(len(out))
        action = rng.randrange(3)
        if action == 0:
            out[k] = "new" + str(rng.randrange(99))
        elif action == 1:
            del out[k]
        else:
            out.insert(k, "new")
    return out


def edit_distance(pattern, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(words, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [text(rng, rng.randrange(10, 60)) for _ in range(30)]
    docs, want = [], set()
    for i in range(300):
        w = text(rng, 150).split()
        if i % 2:
            item = rng.randrange(30)
            at = rng.randrange(len(w))
            w[at:at] = edited(rng, items[item].split(), rng.choice([0, 0.05, 0.1, 0.15]))
        docs.append((i, " ".join(w)))
    for i, t in docs:
        want |= {(i, k) for k, x in enumerate(items) if edit_distance(x.split(), t.split()) <= int(0.2 * len(x.split()))}
    got = decontaminate.leaks(documents(spark, docs), spark.createDataFrame(list(enumerate(items)), BENCHMARK)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(want) >= 140 and found <= want and len(found) >= 0.97 * len(want)
    for r in got[:40]:
        w, x = dict(docs)[r.doc_id].split(), items[r.item_id].split()
        assert r.distance == edit_distance(x, w) and edit_distance(x, w[r.start_word : r.end_word]) == r.distance


def test_kneser_ney_against_formulas(spark):
    """Scores equal those of a plain dictionary model with the same discounts."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("aabcde") for _ in range(30)) for _ in range(40)]
    values, known = perplexity.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    tri = defaultdict(int)
    for t in texts:
        x = ["<s>", "<s>", *t.split(), "</s>"]
        for g in zip(x, x[1:], x[2:]):
            tri[g] += 1

    def discounted(counts):
        n = [max(1, sum(c == i for c in counts.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        total, left = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        return {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] for g, c in counts.items()}, {k: left[k] / total[k] for k in total}

    bi, uni = defaultdict(int), defaultdict(int)
    for g in tri:
        bi[g[1:]] += 1
    for g in bi:
        uni[g[1:]] += 1
    (q3, g3), (q2, g2), (q1, g1) = map(discounted, (tri, bi, uni))

    def p(u, v, w):
        p1 = q1[w,] + g1[()] / (len(uni) + 1)  # one more for unknown words
        p2 = q2.get((v, w), 0) + g2.get((v,), 1) * p1
        seen = tri.get((u, v, w), 0) >= perplexity.MIN_TRIGRAM_COUNT
        return (q3[u, v, w] if seen else 0) + g3.get((u, v), 1) * p2

    test = "a b c a e d a a b c d e"
    x = ["<s>", "<s>", *test.split(), "</s>"]
    want = sum(np.log(p(*g)) for g in zip(x, x[1:], x[2:]))
    docs = spark.createDataFrame([(1, "en", False, test)], "doc_id long, lang string, held_out boolean, text string")
    assert perplexity.score(docs, values, known).first().nats == pytest.approx(want, abs=1e-3)


def test_classifier_tells_junk(spark):
    rng = random.Random(9)
    good = [(i, text(rng, 80)) for i in range(900)]
    bad = [(1000 + i, " ".join("zz" + str(rng.randrange(10**6)) for _ in range(80))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in perplexity.classify(documents(spark, good + bad), labels).collect()}
    assert not any(out[i] for i, _ in bad) and sum(out[i] for i, _ in good) >= 0.97 * len(good)


def test_passages(spark):
    rng = random.Random(7)
    passage = text(rng, 70)
    fuzzy = " ".join(edited(rng, passage.split(), 0.06))
    rows = [(i, text(rng, 100) + (f" {passage} " if i < 4 else f" {fuzzy} " if i == 4 else " ") + text(rng, 50)) for i in range(30)]
    rows += [(40, rows[20][1])]
    for k in range(5):  # one of three has but a part, whichever of them is the reference
        other = text(rng, 70)
        parts = [other, other, " ".join(other.split()[:40])]
        rows += [(100 + 3 * k + j, text(rng, 30) + f" {x} " + text(rng, 30)) for j, x in enumerate(parts)]
    got = substrings.repeated_passages(documents(spark, rows)).collect()
    linked = {x for r in got for x in (r.doc_id, r.ref_doc_id)}
    assert {0, 1, 2, 3, 4, 20, 40} == {x for x in linked if x < 100}
    assert all({100 + 3 * k, 101 + 3 * k} & {r.doc_id for r in got} for k in range(5))
    assert all(r.start_word == 100 and abs(r.end_word - 170) <= 6 for r in got if r.doc_id < 5)
    docs = documents(spark, rows)
    cut = {r.doc_id: r.text for r in substrings.cut_passages(docs).collect()}
    assert len(cut) == len(rows) - 1 and sum(passage in t for t in cut.values()) <= 1 and cut[5] == rows[5][1]
    assert max(len(set(passage.split()) & set(t.split())) for t in cut.values()) >= 0.9 * len(set(passage.split()))


def test_chains_against_all_subsets():
    rng = random.Random(4)
    for _ in range(60):
        segments = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(3, 9)) for _ in range(7)})
        best = 0.0
        for bits in range(1, 1 << len(segments)):
            chosen = [s for i, s in enumerate(segments) if bits >> i & 1]
            if all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(chosen, chosen[1:])):
                gaps = sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(chosen, chosen[1:]))
                best = max(best, sum(s[2] for s in chosen) - substrings.GAP_COST * gaps)
        chain = [segments[i] for i in substrings.chains(segments)[0]]
        gaps = sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(chain, chain[1:]))
        assert sum(s[2] for s in chain) - substrings.GAP_COST * gaps == pytest.approx(best)


@pytest.mark.parametrize("frequent", [64, 3])
def test_jaccard_against_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT_DF", frequent)
    rng = random.Random(11)
    rows = []
    for base in range(40):
        words = text(rng, rng.randrange(3, 120)).split()
        rows += [(len(rows) + k, " ".join(edited(rng, words, rng.choice([0, 0, 0.01, 0.03, 0.06])))) for k in range(rng.choice([1, 2, 5, 12]))]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    for r in jaccard_join.jaccard_classes(documents(spark, rows)).collect():
        root = r.doc_id
        while parent[root] != root:
            root = parent[root]
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5), (None, 1)] + [(i, i + 1) for i in range(100, 130)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[9] == 8 and got[130] == 100 and got[5] == 5


def test_rules_keep_prose(spark):
    rng = random.Random(8)
    common = quality_rules.COMMON_WORDS["en"]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(WORDS)[1:] + "ing" for _ in range(120))
    rows = [(i, prose()) for i in range(60)] + [(60, "%%% *** !!! " * 60), (61, "a b c " * 60), (62, "#$ x")]
    out = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert sum(out[i].kept for i in range(60)) == 60 and not any(out[i].kept for i in (60, 61, 62))
    assert (out[62].n_words, out[62].word_chars, out[62].n_symbols, out[61].n_repeat_words) == (2, 3, 2, 180)
    docs = documents(spark, rows)
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60))


@pytest.mark.parametrize("page,want", [
    ("<body><nav>m</nav><article><h1>T</h1><p>a <b>b</b>c<br>d &amp; e</article><footer>f</footer>", "T a bc d & e"),
    ("<div class='cookie-notice'>x</div><p>one<p>two<script>var a='</p>';</script><!-- c --><form>q</form>", "one two"),
    ("<article><p>x</p><div id=comments>no</div><aside>no</aside></article><p>out</p>", "x"),
    ("a &lt;b&gt; <unclosed", "a <b>"), ("", ""), ("<article></article>", ""),
])
def test_main_text(page, want):
    assert html_extract.main_text(page, set()) == want


def test_style_tree_finds_frame(spark):
    rng = random.Random(6)
    page = "<html><body><div class='box'>Same words on every page</div><div class='story'>{}</div></body></html>"
    pages = [(i, "http://h/", page.format(entities.escape(text(rng, 20)))) for i in range(20)]
    out = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all("Same words" not in r.text and len(r.text.split()) == 20 for r in out)


def test_warc_round_trip_and_pushdown(spark):
    pages = [(i, f"http://h/{i}", ["", "x" * i, "same ä"][i % 3]) for i in range(60)] + [(70, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = defaultdict(int)
    for i, _, h in pages:
        first[h or ""] = max(first[h or ""], i)
    for r in warc.round_trip(df).collect():
        data = (dict((i, h) for i, _, h in pages)[r.page_id] or "").encode()
        top = first[data.decode()]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if top == r.page_id else ("revisit", top))
    path = tempfile.mkdtemp(prefix="spark-")
    warc.write_warc(warc.page_records(df, 10**9), path)
    found = warc.read_warc(spark, path).where("target_uri = 'http://h/4' AND record_type IN ('response', 'request')")
    assert [bytes(r.payload) for r in found.collect()] == [b"xxxx"] and "payload" in found.columns
    assert warc.read_warc(spark, path, payload=False).where("payload IS NULL").count() == 61
    reader = warc.WarcReader(path, True)
    assert [type(f).__name__ for f in reader.pushFilters([warc.EqualTo(("record_type",), "x"), warc.EqualTo(("payload_bytes",), 1)])] == ["EqualTo"]


def test_packing_is_exact_and_tight(spark):
    rng = random.Random(10)
    rows = [(i, text(rng, rng.choice([0, 3, 40, 300, 5000]))) for i in range(120)]
    out = packing.pack(documents(spark, rows), BPE, capacity=512).collect()
    from tokenizers import Tokenizer

    tokenizer, sequences, pieces = Tokenizer.from_file(BPE), defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            own = np.array(ids[512 * k : 512 * k + 512], "<u4")
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 512 * k, len(own), zlib.crc32(own.tobytes()))
        assert sum(r.length for r in pieces[i]) == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= 1 + -(-sum(r.length for r in out) // 512)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), None
    columns = docs.columns
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, d)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == kept
    second = corpus_pipeline.STAGES[1][1](spark, first, d)
    assert second.columns == columns
    classes = jaccard_join.jaccard_classes(first).collect()
    assert {r.doc_id for r in second.collect()} == {r.component_id for r in classes}
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.component_id for r in classes}
