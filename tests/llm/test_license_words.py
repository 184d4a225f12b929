"""Words of license scans against the contract's pattern on lower-cased text."""

import random
import re

from meshlens.llm import licenses
from tests.llm.test_operators import documents


def test_word_counts_against_brute_force(spark):
    rng = random.Random(23)
    vocabulary = "GNU General PUBLIC license Apache MIT cc BY X iPhone É é A 2".split()
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "-", ",", "\n", "[", ""]) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(200, "WORD " * 150)]
    for r in licenses.scan_licenses(documents(spark, rows)).collect():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", dict(rows)[r.doc_id].encode().lower())
        at = [k for p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
