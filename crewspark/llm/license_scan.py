"""License scans by templates with markup.

A template is the wording of a license or notice, in which `[[...]]` may be left out, `{a,b}` stands for
a to b words of any kind (names, years, addresses) and `a|b` for either word; what remains is mandatory.
All templates and the base phrases are compiled into one automaton over words, whose sets of places are
made into states as texts need them.  A text is read once: where a pair of words can begin a template the
automaton runs until nothing can be accepted any more.

Null and empty texts have no words, no labels and a score of 0; repeated rows give repeated rows; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crewspark.llm.common import map_batches, pick
from crewspark.llm.textscan import ALNUM, scan

#: Phrases that are always reported, and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

_LIABLE = """in no event shall {1,12} be liable for any direct indirect incidental special exemplary or consequential damages including but
    not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
    theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of
    this software even if advised of the possibility of such damage"""
_AS_IS = """this software is provided by {1,12} as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed"""
_REDISTRIBUTE = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following
    disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
    disclaimer in the documentation and or other materials provided with the distribution"""
_CC = "creative commons attribution"
_CC_END = "[[1|2|3|4 0|5]] [[international|unported|generic]] [[public]] license|licence"
_NON, _SHARE, _NO = ("noncommercial", "non commercial"), ("sharealike", "share alike"), ("noderivatives", "noderivs", "no derivatives")

#: Wording of public licenses and their usual notices.
TEMPLATES = [
    ("mit", "under the [[terms of the]] mit license|licence"),
    ("mit", "license|licence mit"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject
        to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express
        or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in
        no event shall {1,12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    ),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies the software is provided as is and {1,6} disclaims
        all warranties with regard to this software""",
    ),
    ("isc", "under the [[terms of the]] isc license|licence"),
    ("bsd-2-clause", f"{_REDISTRIBUTE} {_AS_IS} {_LIABLE}"),
    (
        "bsd-3-clause",
        f"""{_REDISTRIBUTE} [[3]] neither the name of {{1,12}} nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission {_AS_IS} {_LIABLE}""",
    ),
    ("bsd-2-clause", "bsd 2 clause [[simplified]] license|licence"),
    ("bsd-3-clause", "bsd 3 clause [[new|revised]] license|licence"),
    ("apache-2", "apache license|licence [[version]] 2 0"),
    ("apache-2", "apache [[software]] 2 0 license|licence"),
    (
        "apache-2",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you
        may obtain a copy of the license at {1,12} unless required by applicable law or agreed to in writing software distributed under
        the license is distributed on an as is basis without warranties or conditions of any kind either express or implied""",
    ),
    ("gpl-2", "gnu general public license|licence [[gpl]] [[as published by the free software foundation]] [[either]] version|v 2"),
    ("gpl-3", "gnu general public license|licence [[gpl]] [[as published by the free software foundation]] [[either]] version|v 3"),
    ("gpl-2", "gnu gpl [[version]] v2|2"),
    ("gpl-3", "gnu gpl [[version]] v3|3"),
    ("lgpl-2.1", "gnu lesser general public license|licence [[as published by the free software foundation]] [[either]] version|v 2 1"),
    ("lgpl-3", "gnu lesser general public license|licence [[as published by the free software foundation]] [[either]] version|v 3"),
    ("agpl-3", "gnu affero general public license|licence [[as published by the free software foundation]] [[either]] version|v 3"),
    ("mpl-2", "mozilla public license|licence [[version|v]] 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "released|placed|dedicated [[{0,4}]] to|into|in the public domain"),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose""",
    ),
    ("cc0", "cc0 1 0"),
    ("cc-by", "cc by 1|2|3|4 0|5"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("cc-by", f"{_CC} {_CC_END}"),
    *[("cc-by-sa", f"{_CC} {sa} {_CC_END}") for sa in _SHARE],
    *[("cc-by-nc", f"{_CC} {nc} {_CC_END}") for nc in _NON],
    *[("cc-by-nc-sa", f"{_CC} {nc} {sa} {_CC_END}") for nc in _NON for sa in _SHARE],
    *[("cc-by-nd", f"{_CC} {nd} {_CC_END}") for nd in _NO],
    *[("cc-by-nc-nd", f"{_CC} {nc} {nd} {_CC_END}") for nc in _NON for nd in _NO],
]

_MARK = re.compile(r"\[\[|\]\]|\{\d+,\d+\}|[^\s\[\]{}]+")


def parse(template: str) -> list:
    """Items of a template: a tuple of words (either), a list (optional) or (least, most) words."""
    stack: list[list] = [[]]
    for m in _MARK.findall(template):
        if m == "[[":
            stack.append([])
        elif m == "]]":
            own = stack.pop()
            stack[-1].append(own)
        elif m[0] == "{":
            stack[-1].append(tuple(int(x) for x in m[1:-1].split(",")))
        else:
            stack[-1].append(tuple(m.split("|")))
    if len(stack) != 1:
        raise ValueError("brackets of a template don't match")
    if not stack[0] or not _is_words(stack[0][0]):
        raise ValueError("a template begins with a mandatory word")
    return stack[0]


def _is_words(item) -> bool:
    return isinstance(item, tuple) and isinstance(item[0], str)


def mandatory(items: list) -> int:
    """Words that every accepted text has."""
    return sum(1 if _is_words(i) else i[0] if isinstance(i, tuple) else 0 for i in items)


class Automaton:
    """All templates over numbered words (0: any other word); states are made as they are reached."""

    def __init__(self, templates: list[list]):
        self.words: dict[str, int] = {}
        self.on_word: list[dict[int, list[int]]] = []
        self.on_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        starts = [self._place() for _ in templates]
        for k, (items, at) in enumerate(zip(templates, starts, strict=True)):
            self.accepts[self._add(items, at)] = k
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.places: list[frozenset] = [frozenset()]
        self.ends: list[list[int]] = [[]]
        self.steps: dict[tuple[int, int], int] = {}
        self.start = self._state(starts)
        n = len(self.words) + 1
        #: May a text with these two words here match a template (or end with one word)?
        self.opens = np.zeros((n, n), dtype=bool)
        for a in range(1, n):
            first = self.step(self.start, a)
            if first:
                self.opens[a] = [bool(self.step(first, b)) or bool(self.ends[first]) for b in range(n)]

    def _place(self) -> int:
        self.on_word.append({})
        self.on_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _add(self, items: list, at: int) -> int:
        for item in items:
            to = self._place()
            if isinstance(item, list):
                self.free[at].append(to)
                self.free[self._add(item, at)].append(to)
            elif _is_words(item):
                for w in item:
                    self.on_word[at].setdefault(self.words.setdefault(w, len(self.words) + 1), []).append(to)
            else:
                least, most = item
                here = at
                for k in range(most + 1):
                    if k >= least:
                        self.free[here].append(to)
                    if k < most:
                        further = self._place()
                        self.on_any[here].append(further)
                        here = further
            at = to
        return at

    def _state(self, places) -> int:
        todo, seen = list(places), set(places)
        while todo:
            for p in self.free[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        key = frozenset(seen)
        if key not in self.states:
            self.states[key] = len(self.places)
            self.places.append(key)
            self.ends.append(sorted({self.accepts[p] for p in key if p in self.accepts}))
        return self.states[key]

    def step(self, state: int, word: int) -> int:
        to = self.steps.get((state, word))
        if to is None:
            reached = [t for p in self.places[state] for t in (*self.on_word[p].get(word, ()), *self.on_any[p])]
            to = self.steps[state, word] = self._state(reached) if reached else 0
        return to

    def run(self, words: list[int]) -> dict[int, int]:
        """Templates that match from the first word on, and the words of their longest match."""
        state, found = self.start, {}
        for k, w in enumerate(words):
            state = self.step(state, w)
            if not state:
                break
            for t in self.ends[state]:
                found[t] = k + 1
        return found


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (places of phrases), base_labels, labels, score and
    matches (label:first:end of each accepted wording, ends exclusive, in order).

    score: the mandatory words of the longest wording that was accepted, as a share of the text's words.
    """
    phrases = PHRASES if phrases is None else phrases
    known = [*phrases, *(TEMPLATES if templates is None else templates)]
    parsed = [parse(t) for _, t in known]
    labels, sizes, n_phrases = [k for k, _ in known], [mandatory(p) for p in parsed], len(phrases)
    longest = max((_longest(p) for p in parsed), default=0)
    made: list = []

    def setup():
        if not made:
            auto = Automaton(parsed)
            vocabulary = sorted(auto.words, key=auto.words.get)
            hashes = scan(pa.array(vocabulary, pa.string()), ALNUM, lower=True).hashes()
            order = np.argsort(hashes)
            made.extend((auto, hashes[order], order + 1))
        return made

    def rows(batch):
        auto, hashes, numbers = setup()
        s = scan(batch.column(1), ALNUM, lower=True)
        own = s.hashes()
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        words = np.where(hashes[at] == own, numbers[at], 0) if len(hashes) else np.zeros(len(own), dtype=np.int64)
        doc = s.doc_of_words()
        after = np.append(words[1:], 0)
        after[:-1][doc[1:] != doc[:-1]] = 0
        places = np.flatnonzero(auto.opens[words, after])
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
        for p in places.tolist():
            d = int(doc[p])
            stop = min(int(s.first[d + 1]), p + longest)
            matches = auto.run(words[p:stop].tolist())
            first = p - int(s.first[d])
            found[d] += [(first, first + n, t) for t, n in matches.items()]
        n_words = s.n_words
        out = [[] for _ in range(8)]
        for d, own_found in enumerate(found):
            base = [a for a, _, t in own_found if t < n_phrases]
            most = max((sizes[t] for _, _, t in own_found), default=0)
            row = (
                len(base), min(base, default=None), max(base, default=None),
                ",".join(sorted({labels[t] for _, _, t in own_found if t < n_phrases})),
                ",".join(sorted({labels[t] for _, _, t in own_found})),
                most / int(n_words[d]) if most else 0.0,
                ",".join(f"{k}:{a}:{b}" for a, b, k in sorted({(a, b, labels[t]) for a, b, t in own_found})),
            )
            for column, value in zip(out[1:], row, strict=True):
                column.append(value)
        out[0] = n_words
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        return [batch.column(0), *[pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)]]

    return map_batches(
        pick(docs, "doc_id", "text"),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string",
        rows,
    )


def _longest(items: list) -> int:
    return sum(1 if _is_words(i) else i[1] if isinstance(i, tuple) else _longest(i) for i in items)


def as_regex(items: list) -> str:
    """The same wording as a regular expression over words that each end with a blank; for checks."""
    return "".join(
        f"(?:{'|'.join(map(re.escape, i))}) " if _is_words(i) else f"(?:[^ ]+ ){{{i[0]},{i[1]}}}" if isinstance(i, tuple) else f"(?:{as_regex(i)})?" for i in items
    )
