"""Words met anew: the tokenizer gets many at once."""

import numpy as np
import public_tokenizers

from meshlens.llm import packing


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode(self, text, **options):
        self.texts += 1
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_unknown_words_are_encoded_together():
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    whole = ids.tokenizer
    texts = ["It's 'S DON'T they'LL 'sabc --'d ñandú ª²x½3 </s> <s> <unk> [INST]", " ".join("".join(chr(97 + i // 26**k % 26) for k in range(3)) + "qz" for i in range(3000))]
    ids.tokenizer = Counting(whole)
    found = ids.of_texts(texts)
    assert found == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ids.tokenizer.texts < 600
