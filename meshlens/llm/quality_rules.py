"""Quality rules: fixed word rules, and the divergence of a text's histograms from its language's.

Every document gets two histograms: of character classes (digits left out: numbers are no fault) and of its language's common words. The
references are the sums over all documents of the language that pass the fixed rules. A document is
rejected if the Jensen-Shannon distance (base 2, 0 to 1) of either histogram from its reference is above
a threshold, unless it or the reference is too short to tell. Only DataFrame functions are used:
one map-only pass measures every text, sums per language are combined before the shuffle, and the table
of references has one row a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, small_side, staged

#: Common words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "as", "be", "on", "are", "by", "this", "or", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "il"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}
#: Documents and references of fewer words aren't judged by their histograms.
MIN_WORDS, MIN_REFERENCE_WORDS = 50, 2000
#: Largest distances of character classes and of common words that are kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.13, 0.4

_WS = r" \t\n\x0B\f\r"
_SPLIT = r"[\\x20\\x09-\\x0D]+"


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` (lang, text) as the columns ``keep`` and what the rules need: words, counts, histograms."""
    lists = F.create_map(*[F.lit(x) for lang, words in COMMON_WORDS.items() for x in (lang, words)])
    d = docs.select(*keep, F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.expr(f"array_remove(split(_t, '{_SPLIT}'), '')"))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.expr("CAST(length(_t) - length(translate(_t, '#*$%&|<>', '')) AS BIGINT)"),
        "_l": F.expr(r"transform(filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]'), x -> xxhash64(x))"),
        "_h": F.expr("transform(_w, x -> xxhash64(x))"),
        "_upper": F.expr(r"length(regexp_replace(_t, '\\P{Lu}+', ''))"),
        "_lower": F.expr(r"length(_t) - length(regexp_replace(_t, '\\p{Ll}+', ''))"),
        "_punct": F.expr(r"length(regexp_replace(_t, '\\P{P}+', ''))"),
        "_n": F.expr("length(translate(_t, '0123456789', ''))"),
        "_space": F.length("_t") - F.length(F.array_join("_w", "")),
        "_padded": F.concat(F.lit(" "), F.lower(F.array_join("_w", "  ")), F.lit(" ")),
        "_common": F.coalesce(lists[F.col("_lang")], F.array().cast("array<string>")),
    })
    d = d.withColumns({
        "n_dup_lines": F.expr("CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)"),
        "_g": F.expr("CASE WHEN size(_h) < 3 THEN array() ELSE transform(sequence(0, size(_h) - 3), i -> xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2))) END"),
        "_chars": F.expr("array(_lower, _upper, _punct, _space, _n - _space - _lower - _upper - _punct)").cast("array<long>"),
        "_hits": F.expr("transform(_common, c -> (octet_length(_padded) - octet_length(replace(_padded, ' ' || c || ' ', ''))) div (octet_length(c) + 2))"),
    })
    d = d.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_g)) = size(_g) THEN NULL ELSE sort_array(transform(_g, (x, i) -> struct(x AS h, i AS i))) END"))
    again = "filter(_s, (x, k) -> coalesce(get(_s, k - 1).h = x.h, false) OR coalesce(get(_s, k + 1).h = x.h, false))"
    d = d.withColumns({
        "n_repeat_words": F.expr(f"CASE WHEN _s IS NULL THEN 0L ELSE CAST(size(array_distinct(flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2))))) AS BIGINT) END"),
        "_words": F.expr("concat(_hits, array(n_words - aggregate(_hits, 0L, (a, x) -> a + x)))"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "_lang", "_chars", "_words"
    )


def references(measures: DataFrame) -> DataFrame:
    """(_lang, _ref_n, _ref_chars, _ref_words): sums over the measured documents that pass the fixed rules."""
    size = {"_chars": 5, "_words": 1 + max(map(len, COMMON_WORDS.values()))}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in size.items() for i in range(n)]
    out = measures.where("NOT base_failed").groupBy("_lang").agg(F.sum("n_words").alias("_ref_n"), *sums)
    arrays = {c: F.array(*[f"{c}{i}" for i in range(n)]) for c, n in size.items()}
    return out.select(
        "_lang", "_ref_n", arrays["_chars"].alias("_ref_chars"), F.filter(arrays["_words"], lambda x: x.isNotNull()).alias("_ref_words")
    )


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms, arrays of counts; null where one is empty."""
    total = "nullif(aggregate({0}, 0L, (a, x) -> a + x), 0)"
    parts = f"zip_with({p}, {q}, (x, y) -> struct(x / {total.format(p)} AS p, y / {total.format(q)} AS q))"
    term = "CASE WHEN x.{0} > 0 THEN x.{0} * log2(2 * x.{0} / (x.p + x.q)) ELSE 0D END"
    return F.expr(f"sqrt(greatest(0D, aggregate({parts}, 0D, (a, x) -> a + {term.format('p')} + {term.format('q')}) / 2))")


def judged(measures: DataFrame, refs: DataFrame) -> DataFrame:
    """``measures`` with char_distance, word_distance and kept."""
    d = measures.join(small_side(refs, 100_000), "_lang", "left")
    d = d.withColumns({"char_distance": distance("_chars", "_ref_chars"), "word_distance": distance("_words", "_ref_words")})
    told = (F.col("n_words") >= MIN_WORDS) & (F.coalesce("_ref_n", F.lit(0)) >= MIN_REFERENCE_WORDS)
    far = (F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)
    return d.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(told & far, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, lang, text) with the rules' figures and the verdict ``kept``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance and word_distance. A null or empty text has no words and fails; a null language is the
    language ''; languages without a list of common words are judged by characters alone. Null ids and
    repeated rows keep their rows, extra columns are ignored, an empty table gives an empty result.
    """
    m = staged(measured(plain(docs, "doc_id", "lang", "text"), "doc_id"), "measures")
    out = judged(m, staged(references(m), "references"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance",
    )


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    m = staged(measured(docs.select("lang", "text", whole), "_row"), "measures")
    refs = staged(references(m), "references")
    return judged(m, refs).where("kept").select("_row.*")


def sql() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    known = ", ".join(f"('{lang}', {words})" for lang, words in COMMON_WORDS.items())
    return rf"""
WITH lists(lang, ws) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, list_slice(ws, i, i + 2) AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
b AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '\p{{Ll}}', '', 'g')) AS c_lower, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS c_upper,
  length(t) - length(regexp_replace(t, '\p{{P}}', '', 'g')) AS c_punct,
  length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS c_digit FROM w LEFT JOIN rw USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
c AS (SELECT rid, 'c' AS kind, unnest(['lower', 'upper', 'punct', 'space', 'other']) AS k,
  unnest([c_lower, c_upper, c_punct, length(t) - word_chars, word_chars - c_lower - c_upper - c_punct - c_digit]) AS n FROM f
  UNION ALL
  SELECT rid, 'w', k, len(list_filter(ws, lambda x: lower(x) = k)) FROM (SELECT rid, f.ws, unnest(lists.ws) AS k FROM f JOIN lists USING (lang))),
h AS (SELECT * FROM c UNION ALL SELECT rid, 'w', '', n_words - coalesce(s, 0) FROM f LEFT JOIN (SELECT rid, sum(n) AS s FROM c WHERE kind = 'w' GROUP BY rid) USING (rid)),
ref AS (SELECT lang, kind, k, sum(n) AS n FROM h JOIN f USING (rid) WHERE NOT base_failed GROUP BY ALL),
n AS (SELECT lang, sum(n_words) AS ref_n FROM f WHERE NOT base_failed GROUP BY lang),
p AS (SELECT rid, h.kind, h.n / nullif(sum(h.n) OVER (PARTITION BY rid, h.kind), 0) AS p, ref.n / nullif(sum(ref.n) OVER (PARTITION BY rid, h.kind), 0) AS q
  FROM h JOIN f USING (rid) JOIN ref ON ref.lang = f.lang AND ref.kind = h.kind AND ref.k = h.k),
js AS (SELECT rid, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist
  FROM p GROUP BY rid, kind)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND coalesce(n.ref_n, 0) >= {MIN_REFERENCE_WORDS}
    AND (coalesce(a.dist, 0) > {MAX_CHAR_DISTANCE} OR coalesce(z.dist, 0) > {MAX_WORD_DISTANCE})) AS kept
FROM f LEFT JOIN n USING (lang) LEFT JOIN js a ON a.rid = f.rid AND a.kind = 'c' LEFT JOIN js z ON z.rid = f.rid AND z.kind = 'w'"""
