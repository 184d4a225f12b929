"""Words kept in generations give the tokenizer's ids, also when tables are emptied all the time."""

import numpy as np
import public_tokenizers
import pytest

from meshlens.llm import packing


@pytest.mark.parametrize("limit", [0, 2000, packing.GENERATION_BYTES])
def test_generations_give_the_tokenizers_ids(monkeypatch, limit):
    monkeypatch.setattr(packing, "GENERATION_BYTES", limit)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    pool = ["It's", "naïve", "x<|y", "<|endoftext|>", "tab\there", "日本", "\x07", "1234", "...", "don't", "  "]
    pool += ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(60)]
    for _ in range(30):
        texts = [" ".join(rng.choice(pool, rng.integers(0, 12))) for _ in range(8)]
        texts += texts[:2]
        want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.of_texts(texts)] == want
        assert words.size <= max(limit, 0)
    assert words.of_texts([]) == []
