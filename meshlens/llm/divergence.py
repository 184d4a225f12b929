"""Source divergence audit: how far the term frequencies of the sources of a language lie from each other.

Every group (lang, source) gives each kept term t the weight p(t) = 1 + floor(10^9 * (count + 2) / (N + 2 V)), so a term that it
lacks has the constant p0 = p(count 0). The distance of two groups is the sum of f(p, q) = floor((p - q)^2 / (p + q))
over all V terms, but nearly all terms of a rare source are absent: by inclusion and exclusion over supports A and B

    sum over A of f(p, q0) + sum over B of f(p0, q) + (V - |A| - |B|) f(p0, q0)
        + sum over A and B of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The first two sums come from histograms of counts (a group's terms with equal counts have one price), the third is a constant,
the last is a join of posting lists on the term. Terms that no two sources share cost nothing beyond their group's histogram.

Counting: tasks count the terms of whole texts by group in tables of bounded size and hand on (lang, source, term, places,
documents); the sums are shuffled by all three, so a hot source or a hot word is spread, then by (lang, term), where a word has one row a
source. What is kept is written once to the shared folder. Pairs of sources are the result's own size and are joined within
their language by salted keys; nothing grows in one task but a term's list of sources.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, staged

ONE = 1_000_000_000
#: Entries of a task's table of counts before it is handed on.
TABLE = 500_000
#: Bytes of a text that are cut into terms at once.
CHUNK = 1 << 20
#: Parts into which a language's histograms are dealt before they meet its sources.
SALTS = 16
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> Counter:
    """Places of each term of a UTF-8 text: runs of ASCII letters, in lower case, and of anything beyond ASCII."""
    if len(text) <= CHUNK:
        return Counter(text.translate(_LETTERS).split())
    found, at, held = Counter(), 0, b""
    while at < len(text):
        part = held + text[at : at + CHUNK].translate(_LETTERS)
        at += CHUNK
        head, space, held = part.rpartition(b" ") if at < len(text) else (part, b"", b"")
        found.update(head.split())
    return found


def _counted(batches):
    """Sums by group and term of the rows of a task, in tables of at most ``TABLE`` entries and a document; a null term marks the group itself."""
    kept: dict[tuple, dict[bytes | None, int]] = {}
    entries = 0

    def handed():
        nonlocal entries
        for (lang, source), table in kept.items():
            keys, packed = list(table), list(table.values())
            for i in range(0, len(keys), 10_000):
                own = keys[i : i + 10_000]
                names = pa.array(own, pa.binary()).cast(pa.string())
                n = pa.array([x >> 32 for x in packed[i : i + 10_000]], pa.int64())
                docs = pa.array([x & 0xFFFFFFFF for x in packed[i : i + 10_000]], pa.int64())
                group = [pa.array([x] * len(own), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*group, names, n, docs], names=["lang", "source", "term", "n", "docs"])
        kept.clear()
        entries = 0

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text")):
            table = kept.setdefault((lang or "", source or ""), {None: 0})
            before = len(table)
            raw = text.as_buffer()
            for term, n in terms(raw.to_pybytes() if raw is not None else b"").items():
                table[term] = table.get(term, 0) + (n << 32) + 1
            entries += len(table) - before
            if entries >= TABLE:
                yield from handed()
    yield from handed()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(count: Column, total: Column, kept: Column) -> Column:
    """p of a term; a billion times a count is beyond a long, hence decimals. Without kept terms there is nothing to divide by."""
    whole = F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)")
    return 1 + _div((count + 2).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)"), whole)


def gap(p: Column, q: Column) -> Column:
    """f(p, q); with p, q of at most 10^9 + 1 the square is within a long."""
    return _div((p - q) * (p - q), p + q)


def postings_of(documents: DataFrame, min_docs: int) -> DataFrame:
    """Staged (lang, source, term, n, lang_n, first) of the terms in at least ``min_docs`` documents of their language.

    ``lang_n`` are the places in the language, ``first`` marks one row of each term; a null term stands for the group.
    """
    parts = plain(documents, "lang", "source", "text").mapInArrow(_counted, _COUNTS)
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    first = (F.row_number().over(of_term.orderBy("source")) == 1) & F.col("term").isNotNull()
    known = sums.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("_docs"), F.sum("n").over(of_term).alias("lang_n"), first.alias("first"))
    return staged(known.where((F.col("_docs") >= min_docs) | F.col("term").isNull()).drop("_docs"), "postings")


def audit(documents: DataFrame, min_docs: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of ``documents``.

    Part ``pair`` has every other source of the language with the distance of the two groups, part ``term`` the ``ranks`` terms
    that set the group apart most: those it has, with more weight than in its language. Ranks go by value, largest first,
    then by the item's bytes. Every row of ``documents`` counts, repeated ones too; null texts, languages and sources are
    empty ones. A group without terms has pairs all the same (0 if its language keeps no term); a language with one source has
    none. Texts are counted in pieces, so long ones need no more memory. An empty table gives an empty result; extra columns are ignored.
    """
    postings = postings_of(documents, min_docs)
    groups = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("support"), F.sum(F.col("first").cast("long")).alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("v").alias("kept"), F.sum("total").alias("lang_total"))
    groups = groups.drop("v").join(langs, "lang")
    groups = staged(groups.withColumn("zero", price(F.lit(0), F.col("total"), F.col("kept"))), "groups")
    others = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    prices = postings.groupBy("lang", "source", "n").agg(F.count("term").alias("terms")).join(groups, ["lang", "source"])
    absent = F.col("n") == 0  # the row that stands for the group
    prices = prices.select(
        "lang", F.col("source").alias("a"), F.when(absent, F.col("kept") - F.col("support")).otherwise(F.col("terms")).alias("terms"),
        price(F.col("n"), F.col("total"), F.col("kept")).alias("p"), F.when(absent, F.col("kept")).otherwise(0).alias("kept"),
        F.pmod(F.hash("source", "n"), F.lit(SALTS)).alias("salt"),
    )
    step = gap(F.col("p"), F.col("zero_b"))
    once = F.when(F.col("a") < F.col("b"), F.col("kept") * step).otherwise(0)  # both sides have priced what both lack
    sided = prices.join(others, ["lang", "salt"]).where("a <> b")
    sided = sided.select("lang", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("terms") * step - once).alias("value"))

    priced = postings.where("term IS NOT NULL").join(groups, ["lang", "source"])
    priced = priced.select(
        "lang", "source", "term", price(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "zero", price(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
    )
    x = priced.select("lang", "term", F.col("source").alias("x"), F.col("p").alias("px"), F.col("zero").alias("zx"))
    y = priced.select("lang", "term", F.col("source").alias("y"), F.col("p").alias("py"), F.col("zero").alias("zy"))
    px, py, zx, zy = (F.col(c) for c in ("px", "py", "zx", "zy"))
    shared = x.join(y, ["lang", "term"]).where("x < y").select("lang", "x", "y", (gap(px, py) - gap(px, zy) - gap(zx, py) + gap(zx, zy)).alias("value"))

    distances = sided.unionByName(shared).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = distances.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    apart = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(apart.withColumn("rank", rank).where(F.col("rank") <= ranks))


def sql(min_docs: int = 10, ranks: int = 10) -> str:
    """DuckDB's SQL for the same, every term of every pair in full."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = f"1 + CAST({ONE} AS HUGEINT) * ({{}} + 2) // ({{}} + 2 * v)"
    f = "({0} - {1}) * ({0} - {1}) // ({0} + {1})"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {min_docs}),
l AS (SELECT d.lang, coalesce(any_value(v), 0) AS v, coalesce(any_value(n), 0) AS n FROM d LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY 1) x USING (lang) GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT d.lang, d.source, coalesce(any_value(n), 0) AS n FROM d LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2) x USING (lang, source) GROUP BY 1, 2),
w AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {p.format('coalesce(c.c, 0)', 'g.n')} AS p, {p.format('k.c', 'l.n')} AS q
 FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum({f.format('a.p', 'b.p')}) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
apart AS (SELECT lang, source, 'term' AS part, term AS item, CAST({f.format('p', 'q')} AS BIGINT) AS value FROM w WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM apart)) WHERE part = 'pair' OR rank <= {ranks}"""
