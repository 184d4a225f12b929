"""What a cut leaves is what was there, byte for byte."""

import random

from meshlens.llm import substrings
from tests.llm.test_operators import WORDS, documents


def test_text_around_cuts_of_sentences_is_kept(spark):
    rng = random.Random(22)
    for k, after in enumerate(["Next MIT words. É iPhone X", "THE WHOLE NEXT SENTENCE, IN CAPITALS.", "Q"]):
        passage = "The " + " ".join(rng.choice(WORDS).capitalize() for _ in range(70)) + " End. "
        sides = [("Alpha Beta: ", "Gamma."), ("Some Text BEFORE it.\n", after)]
        texts = [a + passage + b for a, b in sides]
        out = {r.doc_id: r.text for r in substrings.cut_passages(documents(spark, list(enumerate(texts)))).collect()}
        assert sorted((out[0] == texts[0], out[1] == texts[1])) == [False, True], k
        cut = 0 if out[1] == texts[1] else 1
        assert out[cut] == "".join(sides[cut])
