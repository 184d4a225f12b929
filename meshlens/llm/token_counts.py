"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary entries that end at each character; dynamic programming carries
the best score and its number of pieces per position. Ties are the tokenizer's: of equal scores the one
whose last piece starts first stays, since later ones replace it only when strictly better. A character
that no one-character piece covers costs the lowest score less ten and counts as its UTF-8 bytes
(byte fallback). Words repeat, so counts are kept per word in a bounded table; the rest is map-only.
"""

from __future__ import annotations

import os
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels
from .common import plain

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
PLACEHOLDER = -1e8
_WORD = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
#: Counts that a worker keeps in each of two generations: when the younger one is full it becomes the elder, and words in use stay.
KEPT_WORDS = 150_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file, in order of ids.

    Byte, control and unknown pieces match no text. Ranks of a merge model serve as scores; its placeholder
    score (-1e9, for pieces that no merge makes) counts as one below the lowest rank.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
    floor = min((score for _, score in pieces if score > PLACEHOLDER), default=0.0) - 1
    return [(piece, max(score, floor) if score <= PLACEHOLDER else score) for piece, score in pieces]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in pieces)
        self.singles = {piece for piece, _ in pieces if len(piece) == 1}
        self.kept: dict[str, int] = {}
        self.elder: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Pieces of the best segmentation of ``word``."""
        size = len(word)
        if self.singles.issuperset(word):  # every place is reached by pieces; of one end the automaton gives the longest first
            score, count = [0.0] + [float("-inf")] * size, [0] * (size + 1)
            for end, (length, own) in self.automaton.iter(word):
                end += 1
                total = score[end - length] + own
                if total > score[end]:
                    score[end], count[end] = total, count[end - length] + 1
            return count[size]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        for end, found in enumerate(ends):
            best, pieces, single = None, 0, False
            for length, own in sorted(found, key=lambda x: -x[0]):  # earliest start first
                total = score[end + 1 - length] + own
                single = single or length == 1
                if best is None or total > best:
                    best, pieces = total, count[end + 1 - length] + 1
            if not single:
                total = score[end] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end] + len(word[end].encode("utf-8", "surrogatepass"))
            score[end + 1], count[end + 1] = best, pieces
        return count[size]

    def __call__(self, text: str) -> int:
        """Tokens of ``text`` with one space put before it and spaces written as pieces write them.

        No piece goes on past the end of a word, so words (with the spaces before them) are counted one
        by one; neither does one hold a line feed, which is one byte piece.
        """
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        words = _WORD.findall(marked) if self.by_word else [marked]
        total, kept = 0, self.kept
        for word in words:
            n = kept.get(word)
            if n is None:
                n = self.elder.get(word)
                if n is None:
                    n = self.viterbi(word)
                if len(kept) >= KEPT_WORDS:
                    self.elder, self.kept = kept, {}
                    kept = self.kept
                if len(word) <= 64:
                    kept[word] = n
            total += n
        return total


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """One counter per worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(vocabulary(path))
    return _COUNTERS[path]


def _counts(path: str):
    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = kernels.texts_of(batch.column("text")).to_pylist()
            n_tokens = pa.array([count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_tokens], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs`` (doc_id, text) under the vocabulary file at ``path``.

    Scores are added exactly. The file must be readable on every executor. Null and empty texts have 0 tokens; null ids and repeated
    rows keep their rows; extra columns are ignored; an empty table gives an empty result. Texts of any
    length take memory in proportion to their longest word only.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", docs["doc_id"].cast("long"))
    return docs.mapInArrow(_counts(os.fspath(path)), "doc_id long, n_tokens long")
