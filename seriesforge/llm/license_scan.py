"""License scans: templates with optional and replaceable regions, as token automata.

A template is words, with `[ ... ]` around what may be missing and `{n}` where
up to n words of one's own may stand. It compiles into a nondeterministic
automaton over words: a state for each place in the template, steps by a word,
by any word, or by none. A text has the license where a run from the template's
first word reaches its end, which is only possible if all mandatory wording
stands there exactly, from its first word to its last.

An automaton is started only where its first words stand (a template begins
with mandatory ones), so that the cost of a text is that of finding these.
Beside the templates, places of the base phrases are counted.

The words of a text are runs of digits, letters and characters beyond ASCII,
with A-Z lower-cased. Null and empty texts have no words, no labels and score
0. Texts may be of any length. Null and repeated doc_id values pass through; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Phrases whose words stand consecutively, and their labels. Fixed values.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [ 1 ] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [ 2 ] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
_NO_WARRANTY = "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {2} general public license for more details"

#: Public license wordings, whole, as templates. Fixed values. The copyright line, title and numbers of clauses may be there or not, and holders and names may be any.
TEMPLATES = {
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of this {2} and associated documentation files [ the software ] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [ including the next paragraph ] shall be included in all copies or substantial portions of the software " + _AS_IS,
    "mit-notice": "released under the mit license",
    "isc-full": "permission to use copy modify and [ or ] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} [ 3 ] neither the name of {{12}} nor the names of {{3}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 [ the license ] you may not use this {3} except in compliance with the license you may obtain a copy of the license at {8} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-2.0-notice": "licensed under the [ terms of the ] [ gnu ] general public license version 2 [ or later ]",
    "gpl-3.0-notice": "licensed under the [ terms of the ] [ gnu ] general public license version 3 [ or later ]",
    "gpl-2.0-header": f"this program {_GNU} 2 of the license or [ at your option ] any later version this program is distributed in the hope that it will be useful {_NO_WARRANTY} you should have received a copy of the gnu general public license along with this program",
    "gpl-3.0-header": f"this program {_GNU} 3 of the license or [ at your option ] any later version this program is distributed in the hope that it will be useful {_NO_WARRANTY} you should have received a copy of the gnu general public license along with this program",
    "lgpl-header": f"this library is free software you can redistribute it and or modify it under the terms of the gnu [ lesser ] [ library ] general public license as published by the free software foundation either version {{2}} of the license or [ at your option ] any later version this library is distributed in the hope that it will be useful {_NO_WARRANTY} you should have received a copy of the gnu [ lesser ] [ library ] general public license along with this library",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {8}",
    "unlicense-full": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _AS_IS.replace("in no event shall {12} be liable", "in no event shall the authors be liable"),
    "cc-by-nc-4.0": "licensed under [ a ] [ the ] cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under [ a ] [ the ] cc by sa 4 0",
    "cc-by-4.0": "licensed under [ a ] [ the ] creative commons attribution 4 0 international [ public ] license",
}

Step = tuple[str | None, int]  # a word (None: any), and the state it leads to


class Automaton:
    """states[i]: steps from place i; skips[i]: places that i reaches without a word. The last state accepts."""

    def __init__(self, template: str):
        self.steps: list[list[Step]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.first: list[str] = []
        opened: list[int] = []
        plain = True
        for token in template.split():
            here = len(self.steps) - 1
            if token == "[":
                opened.append(here)
                plain = False
            elif token == "]":
                self.skips[opened.pop()].append(here)
            elif m := re.fullmatch(r"\{(\d+)\}", token):
                plain = False
                for _ in range(int(m[1])):
                    self.steps[-1].append((None, len(self.steps)))
                    self._state()
                for i in range(here, len(self.steps) - 1):
                    self.skips[i].append(len(self.steps) - 1)
            else:
                self.steps[-1].append((token, len(self.steps)))
                self._state()
                if plain:
                    self.first.append(token)
        if opened or not self.first:
            raise ValueError(f"a template begins with words and closes its brackets: {template}")
        self.end = len(self.steps) - 1

    def _state(self) -> None:
        self.steps.append([])
        self.skips.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, word, at: int, end: int) -> int | None:
        """Where the longest match that starts with word(at) ends, in words; word(i) gives word i, up to end."""
        states, found = self._closed({0}), None
        while True:
            if self.end in states:
                found = at
            if at >= end or not states:
                return found
            w = word(at)
            states = self._closed({to for s in states for want, to in self.steps[s] if want is None or want == w})
            at += 1


@functools.cache
def _tables() -> tuple[np.ndarray, bytes]:
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return inside, bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


class _Words:
    """The words of a slice of texts: where they begin and end, and the text each belongs to."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        inside, lower = _tables()
        self.raw = data.tobytes().translate(lower)
        flag = inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        self.begin = np.flatnonzero(flag & (edge[:-1] | np.concatenate([[True], ~flag[:-1]]))) if len(data) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(flag & (edge[1:] | np.concatenate([~flag[1:], [True]]))) + 1 if len(data) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.begin, starts)  # of each text, its first word

    def word(self, i: int) -> str:
        return self.raw[self.begin[i] : self.end[i]].decode("utf-8", "replace")

    def places(self, phrase: tuple[str, ...]) -> list[tuple[int, int]]:
        """Text and first word of each place of a phrase; its longest word is looked up, the others compared."""
        key = max(range(len(phrase)), key=lambda i: len(phrase[i]))
        needle, out, at = phrase[key].encode(), [], self.raw.find(phrase[key].encode())
        while at >= 0:
            i = int(np.searchsorted(self.begin, at))
            if i < len(self.begin) and self.begin[i] == at and self.end[i] == at + len(needle):
                text = int(np.searchsorted(self.first, i, "right")) - 1
                lo = i - key
                if lo >= self.first[text] and lo + len(phrase) <= self.first[text + 1] and all(self.word(lo + j) == w for j, w in enumerate(phrase) if j != key):
                    out.append((text, lo))
            at = self.raw.find(needle, at + len(needle))
        return out


@C.tidy
def _scan(templates: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machines = {label: Automaton(t) for label, t in templates.items()}
    starts_with: dict[tuple[str, ...], list[str]] = {}
    for label, m in machines.items():
        starts_with.setdefault(tuple(m.first), []).append(label)
    for batch in C.slices(batches):
        data, starts = C.text_bytes(batch.column("text"))
        words = _Words(data, starts)
        n = batch.num_rows
        spans: list[list[tuple[int, int, str, bool]]] = [[] for _ in range(n)]
        for phrase, label in BASE.items():
            for text, at in words.places(phrase):
                spans[text].append((at - int(words.first[text]), at - int(words.first[text]) + len(phrase), label, True))
        for phrase, labels in starts_with.items():
            for text, at in words.places(phrase):
                for label in labels:
                    to = machines[label].match(words.word, at, int(words.first[text + 1]))
                    if to is not None:
                        spans[text].append((at - int(words.first[text]), to - int(words.first[text]), label, False))
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
        rows = [[dict(zip(("start", "end", "label", "base"), s, strict=True)) for s in sorted(x)] for x in spans]
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(rows, pa.list_(kind))], names=["doc_id", "n_words", "spans"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words long and spans array<struct<start,end,label,base>>: places in words from 0, end exclusive; base for phrases, else a whole template."""
    return C.with_text(docs).mapInArrow(functools.partial(_scan, dict(templates)), "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint,label:string,base:boolean>>")
