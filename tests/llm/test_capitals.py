"""Words in capitals are words: passages and copies, whatever their case."""

import random

from meshlens.llm import substrings
from tests.llm.test_operators import documents, text


def styled(words, style):
    if style == "upper":
        return words.upper()
    return " ".join(w.capitalize() if k % 3 == 0 else w[:2] + w[2:].upper() for k, w in enumerate(words.split())) if style == "mixed" else words


def test_passages_and_copies_in_capitals(spark):
    rng = random.Random(21)
    rows, passages = [], [("upper", "upper"), ("mixed", "mixed"), ("lower", "upper"), ("mixed", "lower")]
    for k, styles in enumerate(passages):
        passage = text(rng, 70)
        rows += [(10 * k + j, f"{text(rng, 40)} {styled(passage, s)} {text(rng, 40)}") for j, s in enumerate(styles)]
    short = " ".join("A" if k % 2 else w for k, w in enumerate(text(rng, 60).split()))  # 60 words, 30 of them one capital
    rows += [(100 + j, text(rng, 60).upper()) for j in range(2)]
    rows += [(110, rows[-1][1]), (120, short), (121, short)]
    got = substrings.repeated_passages(documents(spark, rows)).collect()
    assert {frozenset((r.doc_id, r.ref_doc_id)) for r in got} == {frozenset((10 * k, 10 * k + 1)) for k in range(4)} | {frozenset((101, 110)), frozenset((120, 121))}
    assert all(abs(r.start_word - 40) <= 2 and abs(r.end_word - 110) <= 2 for r in got if r.doc_id < 100)
    assert all((r.start_word, r.end_word) == (0, 60) for r in got if r.doc_id >= 100)
