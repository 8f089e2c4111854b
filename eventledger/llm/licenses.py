"""License scans by template markup: texts of licences with optional and replaceable regions as token automata.

Templates written in the legacy SPDX markup are taken by from_spdx().

Markup: `[...]` is optional, `{a-b}` stands for a to b words of any kind, anything else is mandatory wording;
case, punctuation and line breaks don't count. Each template is compiled once to a nondeterministic automaton over
word hashes. It is run from every place whose two words can begin it and accepts a text whose mandatory wording
stands there exactly. Beside accepted templates, labels come from fixed short phrases.

Score: 1 if any label was found; else the largest share of a template's mandatory words that a run matched. For the score
alone a run goes on over a wrong word, not over two on end, so a long text altered early still scores what it keeps.

Defined results: null and empty texts have no words, null places, empty labels and score 0; rows are independent, so
repeated rows have repeated results; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytewords import ALNUM, Words, groups, words_of
from .common import read, trimmed

#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Passages that several templates share.
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
    documentation files [the software] to deal in the software without restriction including without limitation the rights to use
    copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
    is furnished to do so"""
_MIT_CONDITION = """subject to the following conditions the above copyright notice and this permission notice [including the next paragraph]
    shall be included in all copies or substantial portions of the software"""
_MIT_DISCLAIMER = """the software is provided as is without warranty of any kind express or implied including but not limited to the
    warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {1-8} be liable for any
    claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with
    the software or the use or other dealings in the software"""
_BSD_GRANT = """redistribution and use in source and binary forms with or without modification are permitted provided that the
    following conditions are met [1] [a] redistributions of source code must retain the above copyright notice this list of conditions
    and the following disclaimer [2] [b] redistributions in binary form must reproduce the above copyright notice this list of
    conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_ADVERTISING = """[3] [c] all advertising materials mentioning features or use of this software must display the following
    acknowledgement this product includes software developed by {1-16}"""
_BSD_NAMES = """neither the name {1-8} nor the names of {1-3} contributors may be used to endorse or promote products derived from this
    software without specific prior written permission"""
_BSD_DISCLAIMER = """this software is provided by {1-8} as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {1-8} be liable for any
    direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
    or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
    strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
    the possibility of such damage"""
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """the software is provided as is and {1-4} disclaims all warranties with regard to this software including all implied
    warranties of merchantability and fitness in no event shall {1-4} be liable for any special direct indirect or consequential damages
    or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
    action arising out of or in connection with the use or performance of this software"""
_APACHE_GRANT = """licensed under the apache license version 2 0 [the license] you may not use {0-3} file except in compliance
    with the license"""
_GPL_GRANT = "{0-2} is free software you can redistribute it and or modify it under the terms of the gnu"
_GPL_VERSION = "general public license as published by the free software foundation either version {1-2} of the license"

#: Templates and their labels; whole licences to the end of their mandatory wording, variants apart. apache-2-notice is
#: the notice's first sentence, apache-2-notice-full the whole.
TEMPLATES = {
    "mit-text": f"{_MIT_GRANT} {_MIT_CONDITION} {_MIT_DISCLAIMER}",
    "mit-0-text": f"{_MIT_GRANT} {_MIT_DISCLAIMER}",
    "json-text": f"{_MIT_GRANT} {_MIT_CONDITION} the software shall be used for good not evil {_MIT_DISCLAIMER}",
    "apache-2-notice": _APACHE_GRANT,
    "apache-2-notice-full": f"""{_APACHE_GRANT} you may obtain a copy of the license at [http] [https] [www] apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
        basis without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license""",
    "bsd-2-text": f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
    "bsd-3-text": f"{_BSD_GRANT} [3] [c] {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-4-text": f"{_BSD_GRANT} {_BSD_ADVERTISING} [4] [d] {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "isc-text": f"""{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies
        {_ISC_DISCLAIMER}""",
    "0bsd-text": f"{_ISC_GRANT} {_ISC_DISCLAIMER}",
    "gpl-notice": f"{_GPL_GRANT} {_GPL_VERSION}",
    "gpl-or-later-notice": f"{_GPL_GRANT} {_GPL_VERSION} or [at your option] any later version",
    "lgpl-notice": f"{_GPL_GRANT} lesser {_GPL_VERSION}",
    "lgpl-or-later-notice": f"{_GPL_GRANT} lesser {_GPL_VERSION} or [at your option] any later version",
    "agpl-notice": f"{_GPL_GRANT} affero {_GPL_VERSION}",
    "agpl-or-later-notice": f"{_GPL_GRANT} affero {_GPL_VERSION} or [at your option] any later version",
    "gpl-line": "under [the] [terms of the] gnu general public license [gpl] version {1-2}",
    "lgpl-line": "under [the] [terms of the] gnu lesser general public license [lgpl] version {1-2}",
    "lgpl-library-line": "under [the] [terms of the] gnu library general public license [lgpl] version {1-2}",
    "agpl-line": "under [the] [terms of the] gnu affero general public license [agpl] version {1-2}",
    "cc-notice": """work is licensed under [a] [the] creative commons attribution [noncommercial] [sharealike] [noderivatives] {1-2}
        [international] license""",
    "mit-line": "[released] [licensed] [distributed] under the mit license",
    "apache-2-line": "licensed under the apache license version 2 [0]",
    "cc-by-nc-line": "[licensed] [released] under [the] cc by nc [sa] [nd] [{1-2}]",
    "spdx-line": "spdx license identifier {1-3}",
    "rights-reserved": "copyright [c] {1-8} all rights reserved",
}


def from_spdx(text: str, most: int = 60) -> str:
    """Markup of a template in the legacy SPDX form: <<beginOptional>> to <<endOptional>>, and <<var;...>> for up to most words."""
    text = re.sub(r"<<beginOptional[^>]*>>", " \x01 ", text)
    text = re.sub(r"<<endOptional>>", " \x02 ", text)
    text = re.sub(r"<<var;.*?>>", " \x03 ", text, flags=re.S)
    words = re.findall(r"[\x01-\x03]|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    signs = {"\x01": "[", "\x02": "]", "\x03": f"{{0-{most}}}"}
    return re.sub(r"\[ \]", "", " ".join(signs.get(w, w) for w in words))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words_of(data, np.array([0, len(data)]), ALNUM).hashes


@dataclass
class Automaton:
    """States by number; a word leads on if it is in words[state], any word if there is wild[state]; empty moves in free."""

    label: str
    words: list = field(default_factory=list)
    wild: list = field(default_factory=list)
    free: list = field(default_factory=list)
    #: Mandatory words passed on the way to a state.
    done: list = field(default_factory=list)
    mandatory: int = 0

    def state(self) -> int:
        self.words.append({})
        self.wild.append([])
        self.free.append([])
        self.done.append(self.mandatory)
        return len(self.words) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: int) -> frozenset[int]:
        out = set()
        for s in states:
            out.update(self.words[s].get(word, ()))
            out.update(self.wild[s])
        return self.closed(out) if out else frozenset()

    def over(self, states: frozenset[int]) -> frozenset[int]:
        """The states after a word that should have led on and did not."""
        return self.closed({t for s in states for ways in self.words[s].values() for t in ways})

    @property
    def end(self) -> int:
        return len(self.words) - 1


def compile_template(label: str, markup: str) -> Automaton:
    a = Automaton(label)

    def sequence(tokens: list[str], at: int, mandatory: bool) -> int:
        while tokens:
            token = tokens.pop(0)
            if token == "]":
                return at
            if token == "[":
                inner = sequence(tokens, at, False)
                last = a.state()
                a.free[inner].append(last)
                a.free[at].append(last)
                at = last
            elif gap := re.fullmatch(r"\{(\d+)-(\d+)\}", token):
                least, most = map(int, gap.groups())
                skip = [at] if least == 0 else []
                for i in range(most):
                    new = a.state()
                    a.wild[at].append(new)
                    at = new
                    if i + 1 >= least:
                        skip.append(at)
                last = a.state()
                for s in skip:
                    a.free[s].append(last)
                at = last
            else:
                a.mandatory += mandatory
                new = a.state()
                a.words[at].setdefault(int(word_hashes(token)[0]), []).append(new)
                at = new
        return at

    start = a.state()
    sequence(re.findall(r"\[|\]|\{\d+-\d+\}|[^\s\[\]{}]+", markup), start, True)
    return a


class Scanner:
    """All automata and phrases, and the pairs of words that can begin an automaton."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        self.phrases = [(word_hashes(k), v) for k, v in phrases.items()]
        self.starts = [a.closed({0}) for a in self.automata]
        self.first = [self._words(a, s) for a, s in zip(self.automata, self.starts)]

    @staticmethod
    def _words(a: Automaton, states: frozenset[int]) -> np.ndarray | None:
        """The words that can come next; none if any can."""
        if any(a.wild[s] for s in states):
            return None
        return np.array(sorted({w for s in states for w in a.words[s]}), dtype=np.uint64)

    def places(self, words: Words) -> list[np.ndarray]:
        """For each automaton the places where a run can get past two words."""
        h = words.hashes
        out = []
        for a, start, first in zip(self.automata, self.starts, self.first):
            if first is None:
                # Begins with any words: look for the words that may follow them, and go back as far as it may.
                known = np.array(sorted({w for d in a.words[: self._gap(a) + 1] for w in d}), dtype=np.uint64)
                at = np.flatnonzero(np.isin(h, known)) if len(known) else np.arange(len(h))
                out.append(at[self._second(h, at, a, known)])
                continue
            at = np.flatnonzero(np.isin(h, first))
            keep = np.zeros(len(at), dtype=bool)
            for w in first:
                then = a.step(start, int(w))
                second = self._words(a, then)
                mine = h[at] == w
                if second is None or a.end in then:
                    keep |= mine
                else:
                    keep |= mine & (at + 1 < len(h)) & np.isin(h[np.minimum(at + 1, len(h) - 1)], second)
            out.append(at[keep])
        return out

    @staticmethod
    def _gap(a: Automaton) -> int:
        at = 0
        while at < len(a.words) and not a.words[at]:
            at += 1
        return at

    def _second(self, h, at, a, known) -> np.ndarray:
        """Of places of the first word after a leading gap, those whose next word can follow too."""
        keep = np.zeros(len(at), dtype=bool)
        base = frozenset(range(self._gap(a) + 1))
        for w in known:
            second = self._words(a, a.step(base, int(w)))
            mine = h[at] == w
            keep |= mine if second is None else mine & np.isin(h[np.minimum(at + 1, len(h) - 1)], second)
        return keep

    def scan(self, words: Words) -> list[tuple]:
        """(words, base places, first, last, base labels, labels, score) of each text."""
        n = len(words.bounds) - 1
        h, owner = words.hashes, words.owner()
        labels: list[set] = [set() for _ in range(n)]
        base: list[set] = [set() for _ in range(n)]
        score = np.zeros(n)
        found = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(h[: max(0, len(h) - len(phrase) + 1)] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[h[at + k] == phrase[k]]
            at = at[owner[at] == owner[at + len(phrase) - 1]]
            found.append(at)
            for i in np.unique(owner[at]):
                base[i].add(label)
        for a, start, first, at in zip(self.automata, self.starts, self.first, self.places(words)):
            lead = 0 if first is not None else 1
            for p in at.tolist():
                doc = owner[p]
                states = self.closed_from(a, start, lead)
                best, wrong, slipped = 0, 0, False
                for w in h[p : words.bounds[doc + 1]].tolist():
                    then = a.step(states, w)
                    if not then and not slipped:
                        then, wrong, slipped = a.over(states), wrong + 1, True
                    else:
                        slipped = False
                    states = then
                    if not states:
                        break
                    best = max(best, max(a.done[s] for s in states) - wrong)
                    if a.end in states:
                        if not wrong:
                            labels[doc].add(a.label)
                        break
                if a.mandatory:
                    score[doc] = max(score[doc], best / a.mandatory)
        places = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        per = np.searchsorted(places, words.bounds)
        out = []
        for i in range(n):
            mine = places[per[i] : per[i + 1]] - words.bounds[i]
            all_ = base[i] | labels[i]
            ends = (int(mine[0]), int(mine[-1])) if len(mine) else (None, None)
            out.append((int(words.bounds[i + 1] - words.bounds[i]), len(mine), *ends, ",".join(sorted(base[i])), ",".join(sorted(all_)), 1.0 if all_ else float(score[i])))
        return out

    def closed_from(self, a: Automaton, start: frozenset[int], lead: int) -> frozenset[int]:
        return a.closed(set(range(self._gap(a) + 1))) if lead else start


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@trimmed
def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        for first, last, data, offsets in groups(batch.column("text")):
            columns = zip(*scanner.scan(words_of(data, offsets, ALNUM)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *arrays], names=["doc_id", *[c.split()[0] for c in _FOUND.split(", ")]])


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what was found in the text, one row for each row of docs."""
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return rows.mapInArrow(_scanned, f"doc_id long, {_FOUND}")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))
