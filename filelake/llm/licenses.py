"""License texts found by templates with optional and replaceable regions.

A template is plain words with three marks: ``<<beginOptional>>`` ... ``<<endOptional>>`` around words that may be
missing (they may nest), and ``<<any:least,most>>`` for a run of that many words of any kind. Punctuation and case do
not count. Each template is compiled to a token automaton, whose states are sets of template positions and are worked
out when first met; a text has the license if some run of its words is accepted, i.e. all mandatory words stand there
exactly. The longest accepted run from a start counts. Before that, a template is only tried on texts that contain its
longest mandatory word at all.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z taken as a-z. Base phrases are counted wherever
their words stand consecutively. Defined cases: a null text is empty; without words all counts are 0, labels empty and
score 0; repeated rows are answered each; extra columns are not read.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm import wordhash

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _opt(words: str) -> str:
    return f"<<beginOptional>>{words}<<endOptional>>"


def _full(name: str, first: str, after: str | None) -> str:
    """The template of a whole license: its terms, from ``first`` to before ``after``, must stand there to the last word."""
    text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
    a, b = text.index(first), len(text) if after is None else text.index(after)
    lead, terms, rest = (b" ".join(WORD.findall(t.lower().encode())).decode() for t in (text[:a], text[a:b], text[b:]))
    return _opt(lead) + terms + _opt(rest)


_ASSURED = (
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
    "of merchantability or fitness for a particular purpose see the gnu general public license for more details"
)

# License notices and texts as templates; those of whole licenses go through to the last mandatory sentence.
TEMPLATES = {
    "mit": [
        "<<beginOptional>>this <<any:1,2>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice <<beginOptional>>including the next "
        "paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall <<any:1,12>> be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 <<beginOptional>>0<<endOptional>> <<beginOptional>>the license "
        "you may not use this file except in compliance with the license <<beginOptional>>you may obtain a copy of the license "
        "at <<any:5,9>> unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
        "for the specific language governing permissions and limitations under the license<<endOptional>><<endOptional>>",
        _full("Apache-2.0", "TERMS AND CONDITIONS FOR USE", "END OF TERMS"),
    ],
    "gpl-1": [_full("GPL-1", "0. This License Agreement", "END OF TERMS")],
    "gpl-2": [_full("GPL-2", "0. This License applies", "END OF TERMS")],
    "gpl-3": [
        "<<beginOptional>>this <<any:1,2>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license "
        "<<beginOptional>>gpl<<endOptional>> version 3 <<beginOptional>>or <<beginOptional>>at your option "
        "any<<endOptional>> later <<beginOptional>>version<<endOptional>><<endOptional>>",
        "under the terms of the gnu general public license as published by the free software foundation "
        "<<beginOptional>>either<<endOptional>> version 3 of the license <<beginOptional>>or at your option any later "
        f"version<<endOptional>> {_opt(_ASSURED)}",
        _full("GPL-3", "0. Definitions.", "END OF TERMS"),
    ],
    "lgpl-2": [_full("LGPL-2", "0. This License Agreement", "END OF TERMS")],
    "lgpl-2.1": [_full("LGPL-2.1", "0. This License Agreement", "END OF TERMS")],
    "lgpl-3": [_full("LGPL-3", "This version of the GNU Lesser", None)],
    "mpl-1.1": [_full("MPL-1.1", "1. Definitions.", "EXHIBIT A -Mozilla")],
    "mpl-2": [_full("MPL-2.0", "1. Definitions", "Exhibit A - Source")],
    "cc-by-nc": [
        "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc "
        "<<beginOptional>><<any:1,1>> 0<<endOptional>> <<beginOptional>>license<<endOptional>>",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        f"following conditions are met {_opt('1')} {_opt('a')} redistributions of source code must retain the above copyright notice this "
        f"list of conditions and the following disclaimer {_opt('2')} {_opt('b')} redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        f"provided with the distribution <<beginOptional>>{_opt('3')} {_opt('c')} all advertising materials mentioning features or use of "
        "this software must display the following acknowledgement this product includes software developed by "
        f"<<any:1,20>><<endOptional>> <<beginOptional>>{_opt('3')} {_opt('4')} {_opt('c')} {_opt('d')} neither the name of <<any:1,30>> "
        f"may be used to endorse or promote products derived from this software without specific {_opt('prior')} written "
        f"permission<<endOptional>> <<beginOptional>>{_opt('3')} {_opt('4')} {_opt('c')} {_opt('d')} the names <<any:0,30>> may not be used "
        f"to endorse or promote products derived from this software without specific {_opt('prior')} written "
        f"permission<<endOptional>> <<beginOptional>>{_opt('3')} {_opt('4')} {_opt('c')} {_opt('d')} the name <<any:0,30>> may not be used "
        f"to endorse or promote products derived from this software without specific {_opt('prior')} written "
        "permission<<endOptional>> this software is provided by <<any:1,20>> as is and any express or implied warranties "
        "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed in no event shall <<any:1,20>> be liable for any direct indirect incidental special exemplary or consequential "
        "damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "isc": [
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or "
        "without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        f"the software is provided as is and <<any:1,12>> {disclaim} all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall <<any:1,12>> be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
        "action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
        "this software" for disclaim in ("disclaims", "disclaim")
    ],
}

_MARK = re.compile(r"<<(beginOptional|endOptional|any:(\d+),(\d+))>>")


class Automaton:
    """A template as positions with edges on a word, on any word, or on nothing; sets of them are states."""

    def __init__(self, template: str):
        self.on_word: list[dict[bytes, int]] = [{}]
        self.on_any: list[int | None] = [None]
        self.on_none: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        at, opened = 0, []
        for token in re.findall(r"<<[^>]*>>|[^<]+", template):
            mark = _MARK.fullmatch(token)
            if mark is None:
                for word in WORD.findall(token.lower().encode()):
                    if not opened:
                        self.mandatory.append(word)
                    at = self._step(at, word)
            elif mark[1] == "beginOptional":
                opened.append(at)
            elif mark[1] == "endOptional":
                end = self._step(at, None)
                self.on_none[at].append(end)
                self.on_none[opened.pop()].append(end)
                at = end
            else:
                for k in range(int(mark[3])):
                    new = self._step(at, None)
                    self.on_any[at] = new
                    if k >= int(mark[2]):
                        self.on_none[at].append(new)
                    at = new
        if opened or not self.mandatory:
            raise ValueError("a template needs mandatory words and closed optional regions")
        self.end = at
        self.anchor = max(self.mandatory, key=len)
        self.states: dict[frozenset[int], dict] = {}
        self.start = self._close({0})
        self.other = {w for d in self.on_word for w in d}

    def _step(self, at: int, word: bytes | None) -> int:
        self.on_word.append({})
        self.on_any.append(None)
        self.on_none.append([])
        if word is not None:
            self.on_word[at][word] = len(self.on_word) - 1
        return len(self.on_word) - 1

    def _close(self, places: set[int]) -> frozenset[int]:
        todo = list(places)
        while todo:
            for to in self.on_none[todo.pop()]:
                if to not in places:
                    places.add(to)
                    todo.append(to)
        return frozenset(places)

    def next(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        word = word if word in self.other else b""
        moves = self.states.setdefault(state, {})
        if word not in moves:
            to = {self.on_word[p][word] for p in state if word in self.on_word[p]}
            to |= {self.on_any[p] for p in state if self.on_any[p] is not None}
            moves[word] = self._close(to)
        return moves[word]

    def accepts(self, words: list[bytes]) -> bool:
        """Whether the whole list of words is one the template allows."""
        state = self.start
        for w in words:
            state = self.next(state, w)
        return self.end in state

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, word after the last) of the longest accepted run from each start, without overlaps."""
        out, at = [], 0
        while at < len(words):
            state, to, last = self.start, at, None
            while state and to < len(words):
                state = self.next(state, words[to])
                to += 1
                if self.end in state:
                    last = to
            if last is None:
                at += 1
            else:
                out.append((at, last))
                at = last
        return out


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]):
        self.base = [(tuple(p.encode().split()), label) for p, label in base.items()]
        self.automata = [(label, Automaton(t)) for label, all_of in templates.items() for t in all_of]

    def scan(self, lowered: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base places, places of templates), each (first word, word after the last, label)."""
        phrases = [(p, label) for p, label in self.base if all(w in lowered for w in p)]
        automata = [(label, a) for label, a in self.automata if a.anchor in lowered]
        if not phrases and not automata:
            return [], []
        words = WORD.findall(lowered)
        base = [(k, k + len(p), label) for p, label in phrases for k in range(len(words) - len(p) + 1)
                if words[k] == p[0] and tuple(words[k : k + len(p)]) == p]
        return base, [(a, b, label) for label, automaton in automata for a, b in automaton.find(words)]


def _count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inside = np.zeros(256, bool)
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z"), ("\x80", "\xff")):
        inside[ord(a) : ord(b) + 1] = True
    held = inside[data]
    first = held.copy()
    first[1:] &= ~held[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = held[starts]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def _scan(base: dict[str, str], templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for batch in batches:
            for at, texts in wordhash.slices(batch.column(1)):
                data, offsets = wordhash.string_bytes(texts)
                n_words = _count_words(data, offsets).tolist()
                raw = data.tobytes().lower()
                rows = []
                for k, n in enumerate(n_words):
                    placed, more = scanner.scan(raw[offsets[k] : offsets[k + 1]])
                    covered = {w for a, b, _ in placed + more for w in range(a, b)}
                    starts = [a for a, _, _ in placed]
                    own = sorted({label for *_, label in placed})
                    rows.append((n, len(placed), min(starts, default=None), max(starts, default=None), ",".join(own),
                                 ",".join(sorted({*own, *(label for *_, label in more)})), len(covered) / n if n else 0.0))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns],
                                                 ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per document: n_words, places of base phrases, their labels, all labels, and the share of words in any place."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_scan(base, templates), SCHEMA)
