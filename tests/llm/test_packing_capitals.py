"""Ids of words with any letter whose case matters are the tokenizer's."""

import sys

import numpy as np
import public_tokenizers

from meshlens.llm import packing


def test_ids_of_capitals_are_the_tokenizers():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0xD800)) if c <= "ɏ" or not packing._PLAIN.search(c.lower())]
    letters += [c for c in map(chr, range(0xE000, sys.maxunicode + 1)) if not packing._PLAIN.search(c.lower())]
    assert len(letters) > 0x24F and {"Ɔ", "Ⱥ", "K"} <= set(letters)
    for c in letters:
        text = f"ab{c}cd {c}{c} x{c}"
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.of_text(text), "<u4").tolist() == want, hex(ord(c))
