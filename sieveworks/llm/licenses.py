"""License notices in running text: exact phrases, and short notices with a few edits.

The fuzzy search splits a notice of which at most k edits are allowed into k + 1
pieces: at least one of them must occur unchanged.  Exact search for the pieces finds
the places; the `regex` library's bounded-error matching confirms the notice there and
gives its span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import blocks as B

# Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices that the fuzzy search looks for, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "this program is free software you can redistribute it and or modify it": "gpl-text",
    "under the terms of the gnu lesser general public license": "lgpl",
    "released under the gnu general public license": "gpl-notice",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc-notice",
    "released into the public domain": "public-domain",
    "released under the mit license": "mit-notice",
    "you may not use this file except in compliance with the license": "apache-text",
    "unless required by applicable law or agreed to in writing software": "apache-warranty",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-3",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "under the terms of the gnu affero general public license": "agpl",
    "under the terms of the gnu free documentation license": "gfdl",
    "made available under the terms of the eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license version 1 0": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc-text",
    "this software is provided as is without any express or implied warranty": "zlib-text",
    "licensed under the open software license": "osl",
    "under the terms of the artistic license": "artistic",
    "under the academic free license": "afl",
    "the python software foundation license": "psf",
    "the open database license": "odbl",
    "the microsoft public license": "ms-pl",
    "the european union public licence": "eupl",
    "the sil open font license": "ofl",
    "university of illinois ncsa open source license": "ncsa",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero public domain dedication": "cc0",
    "unauthorized copying of this file is strictly prohibited": "proprietary",
    "the server side public license": "sspl",
    "the business source license": "busl",
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("notices", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))),
])
DDL = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "notices array<struct<label:string,start:bigint,end:bigint,edits:int>>"
)


@dataclass(frozen=True)
class Seed:
    notice: int
    offset: int  # where the piece begins in its notice


class NoticeFinder:
    """Finds the notices with at most one edit for every `chars_per_edit` characters."""

    def __init__(self, notices: dict[str, str] = NOTICES, chars_per_edit: int = 12):
        self.notices = list(notices.items())
        self.edits = [len(text) // chars_per_edit for text, _ in self.notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}") for (text, _), k in zip(self.notices, self.edits, strict=True)]
        self.words = [set(text.split()) for text, _ in self.notices]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[Seed]] = {}
        for n, ((text, _), k) in enumerate(zip(self.notices, self.edits, strict=True)):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(text[a:b], []).append(Seed(n, a))
        for piece, seeds in found.items():
            self.seeds.add_word(piece, (len(piece), seeds))
        self.seeds.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of each notice in a text of words joined by blanks.

        A piece of a notice that stands in the text unedited says where the notice would begin, give or take its edits, so
        each place is searched in a window of the notice's length and a few letters, and the work grows with the pieces found.
        Pieces repeat in ordinary prose; a place is verified only if enough of the notice's
        words lie around it: each edit spoils two words at most, and the first and the last word
        may be part of longer ones."""
        windows: set[tuple[int, int, int]] = set()
        for end, (length, seeds) in self.seeds.iter(text):
            for s in seeds:
                size, k = len(self.notices[s.notice][0]), self.edits[s.notice]
                a = max(0, end + 1 - length - s.offset - k)
                windows.add((s.notice, a, min(len(text), a + size + 3 * k)))
        found = set()
        for n, a, b in windows:
            words, k = self.words[n], self.edits[n]
            need = len(words) - 2 * k - 2
            if need > 0 and len(words.intersection(text[a:b].split(" "))) < need:
                continue
            if m := self.patterns[n].search(text, a, b):
                found.add((n, sum(m.fuzzy_counts), *m.span()))
        return sorted(_apart(found))


def _apart(found: set[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Of each notice's matches (notice, edits, start, end) those with fewest edits, from left to right, none over another."""
    taken: list[tuple[int, int]] = []
    now = None
    for n, edits, start, end in sorted(found):
        if n != now:
            now, taken = n, []
        at = bisect_right(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            yield start, end, n, edits


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, chars_per_edit: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its exact phrases, its notices with their edits, all labels.

    Words are runs of letters, digits and characters beyond ASCII, A-Z folded.  Spans of
    notices are in code points of the text.  score: 1 with an exact phrase, else the best
    notice's share of unedited characters, else 0.  Null text counts as empty (no words,
    no labels).  Repeated rows and ids are scanned each by itself; other columns are
    ignored; an empty table gives an empty result.
    """
    split = [(p, label) for p, label in phrases.items()]

    def run(batches):
        finder = NoticeFinder(notices, chars_per_edit)
        for part, texts in B.rows_of_text(batches):
            rows = []
            for text in texts:
                low = text.translate(_FOLD) if not text.islower() else text
                words = _WORD.findall(low)
                line = " ".join(words)
                padded = f" {line} "
                starts, labels = [], set()
                for phrase, label in split:
                    at, word, counted = padded.find(f" {phrase} "), 0, 0
                    while at >= 0:
                        word, counted = word + padded.count(" ", counted, at), at
                        starts.append(word)
                        labels.add(label)
                        at = padded.find(f" {phrase} ", at + 1)
                found, best, near = [], 1.0 if starts else 0.0, set()
                hits = finder.spans(line)
                if hits:
                    heads, at = [], 0
                    for w in words:
                        heads.append(at)
                        at += len(w) + 1
                    places = [m.span() for m in _WORD.finditer(low)]
                    for a, b, n, edits in hits:
                        first, last = max(0, bisect_right(heads, a) - 1), max(0, bisect_right(heads, max(a, b - 1)) - 1)
                        found.append({"label": notices_list[n][1], "start": places[first][0], "end": places[last][1], "edits": edits})
                        near.add(notices_list[n][1])
                        best = max(best, 1 - edits / len(notices_list[n][0]))
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | near)), best, found))
            yield B.batch(SCHEMA, part.column(0), *(list(c) for c in zip(*rows, strict=True)))

    notices_list = list(notices.items())
    return B.text_rows(docs, id_col, text_col).mapInArrow(run, DDL)
