"""License scans by template-markup matching.

A template is license wording with markup: ``<<optional>>…<<end>>`` may be absent, ``<<var N>>`` stands
for up to N words of any kind, the rest is mandatory. Templates compile to token automata (one bit per
position) that accept word sequences whose mandatory wording matches exactly. Only places where a
template's longest opening of literal words occurs start an automaton, found by one pass of a compiled
expression over the whole text. Everything is per row: no shuffle, memory bounded by one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels
from .common import plain

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label: marked-up wording. Word breaks and case don't matter.
TEMPLATES = {
    "notice:mit": "<<var 3>> under <<optional>>the<<end>> <<optional>>terms of the<<end>> mit license",
    "notice:gpl": "licensed under the <<optional>>terms of the<<end>> gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general "
    "public license <<optional>>as published by the free software foundation<<end>> version <<var 1>>",
    "notice:apache-2.0": "licensed under the apache license version 2 0 <<optional>>the license<<end>>",
    "notice:cc-by": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by <<optional>>nc<<end>> <<optional>>sa<<end>> "
    "<<optional>>nd<<end>> <<var 2>>",
    "text:mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to use "
    "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
    "is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "<<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the "
    "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall <<var 6>> be liable for any claim "
    "damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software",
    "text:isc": "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without "
    "fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "text:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met <<var 1>> redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer",
    "text:gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version <<var 1>> of the license or at your option any "
    "later version",
}

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = re.compile(r"<<(optional|end|var (\d+))>>|[^\s<]+")


class Automaton:
    """Token automaton of one template: position i is left by its word, by any word, or by a skip."""

    def __init__(self, template: str):
        self.words: dict[bytes, int] = {}
        self.any = 0
        self.skips: list[tuple[int, int]] = []
        self.lead: list[bytes] = []  # leading words that every match starts with
        size, opened, leading = 0, [], True
        for m in _MARK.finditer(template):
            if m[2]:
                stop = size + int(m[2])
                for i in range(size, stop):
                    self.any |= 1 << i
                    self.skips.append((i, i + 1))
                size, leading = stop, leading and not self.lead
                if not self.lead:
                    self.offset = stop  # words before the literal opening are searched backwards
            elif m[1] == "optional":
                opened.append(size)
                leading = leading and not self.lead
            elif m[1] == "end":
                self.skips.append((opened.pop(), size))
            else:
                word = m[0].lower().encode()
                self.words[word] = self.words.get(word, 0) | 1 << size
                size += 1
                if leading and not opened:
                    self.lead.append(word)
        self.final = 1 << size
        self.offset = getattr(self, "offset", 0)
        self.skips.sort()

    def closure(self, states: int) -> int:
        for i, j in self.skips:
            if states >> i & 1:
                states |= 1 << j
        return states

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End (exclusive) of the longest match from word ``start``, or None."""
        states, end = self.closure(1), None
        for i in range(start, len(words)):
            states = self.closure(((states & self.words.get(words[i], 0)) | (states & self.any)) << 1)
            if states & self.final:
                end = i + 1
            if not states & ~self.final:
                break
        return end


def _any(phrases: Iterable[list[bytes]]) -> re.Pattern:
    found = (_GAP.join(re.escape(w) for w in p) for p in phrases)
    return re.compile(rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + rb"|".join(rb"(" + p + rb")" for p in found) + rb")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])")


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.labels = list(phrases.values())
        self.phrases = _any([x.encode() for x in phrase.split()] for phrase in phrases)
        self.templates = [(label, Automaton(t)) for label, t in templates.items()]
        self.leads = [_any([a.lead]) for _, a in self.templates]

    def scan(self, text: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Base places (first word, label) and template matches (first word, end word, label) of lower-cased ``text``."""
        places = [(m.start(), self.labels[m.lastindex - 1]) for m in self.phrases.finditer(text)]
        leads = [(k, m.start()) for k, lead in enumerate(self.leads) for m in lead.finditer(text)]
        if not places and not leads:
            return [], []
        spans = [m.span() for m in re.finditer(WORD, text)]
        starts = np.array([s for s, _ in spans])
        base = [(int(np.searchsorted(starts, at)), label) for at, label in places]
        found, words = [], [text[a:b] for a, b in spans] if leads else []
        for k, at in leads:
            label, automaton = self.templates[k]
            word = int(np.searchsorted(starts, at))
            for start in range(max(0, word - automaton.offset), word + 1):
                if end := automaton.longest(words, start):
                    found.append((start, end, label))
                    break
        return base, found


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for row, texts in kernels.chunks(batch, "text"):
                w = kernels.words(texts, kernels.NON_ALNUM)
                rows = []
                for text, n in zip(texts.cast(pa.large_binary()).to_pylist(), w.count.tolist()):
                    base, found = scanner.scan(text.lower())
                    first = [i for i, _ in base]
                    own = {label for _, label in base}
                    rows.append({
                        "n_words": n, "n_base": len(base), "first_word": min(first, default=None), "last_word": max(first, default=None),
                        "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x[2] for x in found})),
                        "score": 1.0 if found else 0.5 if base else 0.0,
                        "matches": [{"label": x[2], "start": x[0], "end": x[1]} for x in found],
                    })
                out = pa.Table.from_pylist(rows, schema=_SHAPE).add_column(0, "doc_id", batch.column("doc_id").slice(row, len(rows)))
                yield from out.to_batches()

    return run


_SHAPE = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
])


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """License phrases and templates in the whole text of every row of ``docs`` (doc_id, text).

    Returns per row: doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels,
    labels (templates' too), score (1 if a template's mandatory wording is there, 0.5 for a phrase alone,
    else 0) and matches, the word spans of templates. A null text counts as empty: no words, no labels,
    score 0, null first and last word. Null ids, repeated rows and extra columns are passed through or
    ignored; an empty table gives an empty result.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", docs["doc_id"].cast("long"))
    shape = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    return docs.mapInArrow(_scan(phrases, templates), shape + "matches array<struct<label: string, start: long, end: long>>")
