"""License scans by template-markup matching.

A template is a licence text with markup: ``<<beginOptional>> ... <<endOptional>>`` may be missing,
``<<var;name="n";original="o";match="m">>`` stands for words that match ``m`` ('.+' and '.*' for any
words, otherwise an expression for one word). A template is compiled into an automaton over words,
and a text bears the licence where the automaton accepts a stretch of its words: all mandatory
wording, exactly and in order, optional regions whole or not at all, replaceable ones filled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, text_of

_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

#: The base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_BULLET = """<<beginOptional>><<var;name="bullet";original="1";match="[0-9a-z]{1,3}">> <<endOptional>>"""
_HOLDER = """<<var;name="holder";original="the copyright holders and contributors";match=".+">>"""

#: Wording that several licences share.
_BSD_CONDITIONS = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met: {_BULLET}Redistributions of source code must retain the above copyright notice, this list of conditions and the
     following disclaimer. {_BULLET}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
     the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_ADVERTISING = f"""{_BULLET}All advertising materials mentioning features or use of this software must display the following acknowledgement:
     This product includes software developed by {_HOLDER} """
_BSD_NAMES = f"""{_BULLET}Neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or promote products derived
     from this software without specific prior written permission. """
_BSD_DISCLAIMER = f"""THIS SOFTWARE IS PROVIDED BY {_HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
     IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR
     ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
     GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
     CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
     ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""

#: The whole wording of public licences, and the notices by which texts refer to them, with their labels.
TEMPLATES = (
    ("mit", """<<beginOptional>>This software is <<endOptional>>Released under the <<beginOptional>>terms of the <<endOptional>>MIT License"""),
    ("mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
     permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial
     portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
     LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_HOLDER} BE
     LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
     CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0"""),
    ("gpl", """<<var;name="subject";original="This program";match="(this|work|program|software|library|file)">>
     <<var;name="noun";original="program";match="(work|program|software|library|file|is)">> <<beginOptional>>is <<endOptional>>
     licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License <<beginOptional>>version
     <<var;name="version";original="3";match="[0-9]+">><<endOptional>>"""),
    ("gpl-3.0", """GNU General Public License <<beginOptional>>as published by the Free Software Foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 3"""),
    ("gpl-2.0", """GNU General Public License <<beginOptional>>as published by the Free Software Foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 2"""),
    ("cc-by-nc", """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY NC <<var;name="major";original="4";match="[0-9]+">>
     <<var;name="minor";original="0";match="[0-9]+">>"""),
    ("cc-by", """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY <<var;name="major";original="4";match="[0-9]+">>
     <<var;name="minor";original="0";match="[0-9]+">>"""),
    ("cc0", """CC0 1.0 Universal"""),
    ("bsd-2-clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("bsd-4-clause", _BSD_CONDITIONS + _BSD_ADVERTISING + _BSD_NAMES + _BSD_DISCLAIMER),
    ("isc", f"""Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
     "AS IS" AND {_HOLDER} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
     FITNESS. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
     RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
     CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
     with this file, You can obtain one at http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/"""),
    ("proprietary", """Copyright <<beginOptional>>(c) <<endOptional>><<var;name="year";original="2020";match="[0-9]{4}">> <<var;name="holder";original="holder";match=".+">> All rights reserved"""),
)


def words_of(text: str | None) -> list[str]:
    """The words of a text, A to Z in lower case."""
    return _words((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes.lower leaves all but A to Z


@dataclass
class State:
    """Where an automaton can go: by a word, by a word that matches an expression, by any word, or without any (empty)."""

    words: dict[str, list[int]] = field(default_factory=dict)
    tests: list[tuple[re.Pattern, int]] = field(default_factory=list)
    anything: int | None = None
    empty: list[int] = field(default_factory=list)


class Template:
    """A template's automaton over words; it starts in state 0 and accepts in ``final``."""

    _markup = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^>]*)?)>>")

    def __init__(self, label: str, markup: str):
        self.label, self.states, self.loops = label, [State()], set()
        open_: list[int] = []
        at, place = 0, 0
        for mark in self._markup.finditer(markup):
            at = self._literal(at, markup[place : mark.start()])
            place = mark.end()
            if mark[1] == "beginOptional":
                open_.append(at)
            elif mark[1] == "endOptional":
                if not open_:
                    raise ValueError(f"{label}: endOptional without beginOptional")
                self.states[open_.pop()].empty.append(at)
            else:
                at = self._variable(at, re.search(r'match="([^"]*)"', mark[2])[1])
        if open_:
            raise ValueError(f"{label}: beginOptional without endOptional")
        self.final = self._literal(at, markup[place:])
        self.opening = [self.states[s] for s in self._closed({0})]

    def _new(self) -> int:
        self.states.append(State())
        return len(self.states) - 1

    def _literal(self, at: int, text: str) -> int:
        for word in words_of(text):
            to = self._new()
            self.states[at].words.setdefault(word, []).append(to)
            at = to
        return self._join(at)

    def _join(self, at: int) -> int:
        """A fresh state after ``at``, so that an optional region's end is shared by nothing else."""
        to = self._new()
        self.states[at].empty.append(to)
        return to

    def _variable(self, at: int, match: str) -> int:
        to = self._new()
        if match in (".+", ".*"):  # a state that any word leads to, and back to
            loop = self._new()
            self.states[at].anything = self.states[loop].anything = loop
            self.states[loop].empty.append(to)
            self.loops.add(loop)
            if match == ".*":
                self.states[at].empty.append(to)
        else:
            self.states[at].tests.append((re.compile(match), to))
        return to

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.states[todo.pop()].empty:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def begins_with(self, word: str) -> bool:
        return any(s.anything is not None or word in s.words or any(test.fullmatch(word) for test, _ in s.tests) for s in self.opening)

    def accepts(self, words: list[str], start: int, spent: dict[int, int]) -> bool:
        """Whether the automaton accepts a stretch of words from ``start``.

        A region of any words goes on to the end of the text. ``spent`` has the places from which runs before
        this one have followed such a region in vain; from there on it is not followed again, so that all runs of a
        text take as long as one.
        """
        at, entered = self._closed({0}), {}
        for i in range(start, len(words)):
            if self.final in at:
                return True
            word, to = words[i], set()
            for s in at:
                state = self.states[s]
                to.update(state.words.get(word, ()))
                to.update(t for test, t in state.tests if test.fullmatch(word))
                if state.anything is not None:
                    to.add(state.anything)
            for loop in self.loops & to:
                entered.setdefault(loop, i)
                if i >= spent.get(loop, len(words)):
                    to.discard(loop)
            if not to:
                break
            at = self._closed(to)
        else:
            if self.final in at:
                return True
        for loop, i in entered.items():
            spent[loop] = min(i, spent.get(loop, i))
        return False


@dataclass
class Scanner:
    """All templates and phrases; finds both in one reading of a text's words."""

    templates: list[Template]
    phrases: list[tuple[list[str], str]]

    def __post_init__(self):
        self.openers = _Openers(self.templates, self.phrases)

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, all labels, score."""
        words = words_of(text)
        places, base, found, spent = [], set(), set(), {}
        for i, (phrases, templates) in [(i, o) for i, o in enumerate(map(self.openers.__getitem__, words)) if o]:
            for phrase, label in phrases:
                if words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
            for t in templates:
                if t.label not in found and t.accepts(words, i, spent.setdefault(id(t), {})):
                    found.add(t.label)
        score = 1.0 if found else 0.5 if base else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


class _Openers(dict):
    """Word to the phrases and templates that can begin with it (None: none), remembered up to a bound."""

    def __init__(self, templates: list[Template], phrases: list[tuple[list[str], str]]):
        super().__init__()
        self.templates, self.phrases = templates, phrases

    def __missing__(self, word: str):
        found = [p for p in self.phrases if p[0][0] == word], [t for t in self.templates if t.begins_with(word)]
        if len(self) > 300_000:
            self.clear()
        opener = self[word] = found if found[0] or found[1] else None
        return opener


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """A row of doc_id and the columns of :data:`SCHEMA` for each row of ``docs`` (doc_id, text).

    n_base counts the places where a phrase's words stand one after another, first_word and last_word
    are the smallest and largest of them (null: none); base_labels are the phrases' labels and labels
    those of the templates too, distinct, sorted and joined by commas. score is 1 if a template
    accepts, 0.5 if only a phrase is found, else 0.

    Null texts count as empty and have no words, places or labels. Whole texts are scanned, however
    long; a null doc_id and repeated rows are scanned like any others; an empty table gives an empty
    result. Further columns are not passed on.
    """
    markup, plain = tuple(templates), tuple(phrases)

    def run(batches):
        scanner = Scanner([Template(*t) for t in markup], [(words_of(p), label) for p, label in plain])
        for batch in batches:
            found = list(zip(*map(scanner.scan, batch["text"].to_pylist()), strict=True)) or [()] * 7
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {id_type(docs)}, {SCHEMA}")
