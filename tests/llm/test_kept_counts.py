"""Counts of words in use outlast those of others, and places that pieces reach only as parts of longer ones."""

from meshlens.llm import token_counts


def test_counts_of_words_in_use_stay(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 50)
    pieces = [(c, -5.0) for c in "▁abcdefghij0123456789"] + [("▁a", -4.0), ("ab", -3.0), ("abc", -3.0), ("bc", -1.0), ("▁ab", -6.0)]
    count = token_counts.UnigramCounter(pieces)
    calls, viterbi = [], count.viterbi
    count.viterbi = lambda word: calls.append(word) or viterbi(word)
    for i in range(500):
        assert count(f"abc {i}") == len("▁a") // 2 + 1 + 1 + len(str(i))
    assert calls.count("▁abc") == 1
    assert len(count.kept) + len(count.elder) <= 100


def test_places_that_only_longer_pieces_reach():
    count = token_counts.UnigramCounter([("▁", -1.0), ("xy", -1.0), ("z", -2.0)])
    assert count("xyz") == 3
    assert count("x") == 2  # x alone is unknown: one byte
    assert count("xé") == 4
