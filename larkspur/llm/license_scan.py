"""License scans: phrase places, and template markup compiled to token automata.

A template is running text with ``[[optional region]]`` (nestable) and ``{{name:min-max}}`` (a replaceable region of
so many words). It is compiled to an automaton over words; a text is accepted where the mandatory words follow one
another exactly, white space, punctuation and case aside. An automaton is only run around places of the template's
anchor, its longest run of mandatory words.

Null texts are empty: no words, null places, empty labels, score 0. Repeated rows each give a row; other columns, whatever
their names, are ignored; an empty table gives no rows. Texts of any length are scanned whole; every place of a phrase
counts, overlapping ones too.
"""

from __future__ import annotations

import importlib.resources
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import batch

#: Base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_WARRANTY = """
this software is provided by {{holder:1-20}} as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
{{holder:1-20}} be liable for any direct indirect incidental special exemplary or consequential damages including but
not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage
"""
_BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice
this list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution
"""
_GNU = "[[this {{work:1-6}} is]] [[free software]] licensed under [[the terms of]] the gnu {{kind}} public license [[as published by the free software foundation]] [[either]] [[v]] version {{number}} [[0]] [[of the license]] [[only]] [[or at your option any later version]]"
_ISSUED = "as published by the free software foundation [[inc]]"
_FSF = "[[this {{work:1-6}} is]] [[free software]] [[you can]] redistribute it and or modify it under the terms of"
#: The Free Software Foundation's notice, with the version after the publisher, after the license and before it.
_NOTICES = (
    _FSF + " the gnu {{kind}} public license " + _ISSUED + " [[either]] [[v]] [[version]] {{number}} [[0]] [[1]] [[of the license]] [[only]] [[or at your option any later version]]",
    _FSF + " the gnu {{kind}} public license [[v]] [[version]] {{number}} [[0]] [[1]] [[of the license]] [[only]] [[or at your option any later version]] " + _ISSUED,
    _FSF + " [[either]] version {{number}} [[0]] [[1]] [[of the license]] [[or at your option any later version]] of the gnu {{kind}} public license",
)
_KINDS = (("gpl", "general"), ("lgpl", "lesser general"), ("agpl", "affero general"))

#: Templates of license texts and notices, by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holder:1-20}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "[[this {{work:1-6}} is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{holder:1-20}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd-2-clause", _BSD + _WARRANTY),
    ("bsd-3-clause", _BSD + "[[3]] neither the name of {{holder:1-20}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" + _WARRANTY),
    ("apache-2", "licensed under the apache license version 2 0 [[the license you may not use this {{work:1-6}} except in compliance with the license]]"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    *((f"{label}-{n}", _GNU.replace("{{kind}}", kind).replace("{{number}}", n)) for label, kind in _KINDS for n in ("2", "3")),
    *((f"{label}-{n}", notice.replace("{{kind}}", kind).replace("{{number}}", n)) for label, kind in (*_KINDS, ("lgpl", "library general")) for n in ("2", "3") for notice in _NOTICES),
    *((f"cc-{kind.replace(' ', '-')}-{n}", f"[[this {{{{work:1-6}}}} is]] licensed under [[a]] [[the]] cc {kind} {n} 0 [[international]] [[license]]") for kind in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd") for n in ("3", "4")),
    *((f"cc-{kind}-{n}", f"[[this {{{{work:1-6}}}} is]] licensed under [[a]] [[the]] creative commons {words} {n} 0 [[international]] [[license]]") for kind, words in (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial")) for n in ("3", "4")),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_MARKUP = re.compile(r"\[\[|\]\]|\{\{(\w+):(\d+)-(\d+)\}\}|[^\s\[\]{}]+")
_ANY = b"*"

#: Labels of the whole license texts in license_texts, from their first terms to their last.
TEXTS = ("apache-2", "gpl-2", "gpl-3", "lgpl-2", "lgpl-3", "mpl-2", "cc-by-sa-4")


def whole_text(label: str) -> str:
    """A whole license text as a template: its words, all mandatory."""
    raw = (importlib.resources.files("larkspur.llm") / "license_texts" / f"{label}.txt").read_bytes()
    return b" ".join(_WORD.findall(raw.lower())).decode()


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass
class Automaton:
    """States in text order: ``words[s]`` leads from s to s + 1, ``skips[s]`` are states reached without a word."""

    label: str
    words: list[bytes] = field(default_factory=list)
    skips: dict[int, list[int]] = field(default_factory=dict)
    done: list[int] = field(default_factory=list)  # mandatory words before each state
    anchor: list[bytes] = field(default_factory=list)
    anchor_at: int = 0

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def run(self, words: list[bytes], start: int) -> tuple[int | None, float]:
        """Where the longest accepted text from ``start`` ends, and the largest share of mandatory words met."""
        last, total = len(self.words), max(self.done[-1], 1)
        now, end, best = self.closure({0}), None, 0
        for k in range(start, len(words)):
            best = max(best, max(self.done[s] for s in now))
            if last in now:
                end = k
            now = self.closure({s + 1 for s in now if s < last and self.words[s] in (words[k], _ANY)})
            if not now:
                break
        else:
            best = max(best, max(self.done[s] for s in now))
            if last in now:
                end = len(words)
        return end, best / total


def compile_template(label: str, text: str) -> Automaton:
    a = Automaton(label, done=[0])
    opened: list[int] = []
    run_start = 0

    def close_run() -> None:
        nonlocal run_start
        if not opened and len(a.words) - run_start > len(a.anchor):
            a.anchor, a.anchor_at = a.words[run_start:], run_start
        run_start = len(a.words)

    def add(word: bytes, counts: bool) -> None:
        a.words.append(word)
        a.done.append(a.done[-1] + counts)

    for m in _MARKUP.finditer(text):
        token = m[0]
        if token == "[[":
            close_run()
            opened.append(len(a.words))
        elif token == "]]":
            a.skips.setdefault(opened.pop(), []).append(len(a.words))
            run_start = len(a.words)
        elif m[1]:
            close_run()
            low, high = int(m[2]), int(m[3])
            first = len(a.words)
            for _ in range(high):
                add(_ANY, False)
            for k in range(low, high):
                a.skips.setdefault(first + k, []).append(len(a.words))
            run_start = len(a.words)
        else:
            add(token.lower().encode(), not opened)
    if opened:
        raise ValueError(f"an optional region of {label} isn't closed")
    close_run()
    if not a.anchor:
        raise ValueError(f"{label} has no mandatory words outside its regions")
    return a


class Scanner:
    def __init__(self, phrases=PHRASES, templates=None):
        self.phrases = [(re.compile(rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(map(re.escape, p.encode().split())) + rb"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"), label) for p, label in phrases]
        self.automata = [compile_template(*t) for t in (templates or (*TEMPLATES, *((label, whole_text(label)) for label in TEXTS)))]
        # a word of each phrase or anchor; a text without any of them can hold neither
        rare = {max(a.anchor, key=len) for a in self.automata} | {max(p.encode().split(), key=len) for p, _ in phrases}
        self.quick = re.compile(b"|".join(sorted(map(re.escape, rare))))

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
        raw = text.encode().lower()  # bytes.lower() changes A-Z alone
        inside = _IN_WORD[np.frombuffer(raw, dtype=np.uint8)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        n_words = int(begins.sum())
        if not self.quick.search(raw):
            return n_words, 0, None, None, "", "", 0.0
        order = np.cumsum(begins) - 1
        places, base = [], set()
        for pattern, label in self.phrases:
            if found := [int(order[m.start()]) for m in pattern.finditer(raw)]:
                places += found
                base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        words = _WORD.findall(raw)
        at: dict[bytes, list[int]] = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        for a in self.automata:
            for k in at.get(a.anchor[0], ()):
                if words[k : k + len(a.anchor)] != a.anchor:
                    continue
                for start in range(max(0, k - a.anchor_at), k + 1):
                    end, share = a.run(words, start)
                    if end is not None and end > k:
                        labels.add(a.label)
                        score = 1.0
                        break
                    score = max(score, round(share, 6)) if score < 1.0 else score
        return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each document; see the module's text for the columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            if b.num_rows:
                yield batch(_ROWS, *zip(*((i.as_py(), *scanner.scan(t.as_py() or "")) for i, t in zip(b.column(0), b.column(1)))))

    return docs.select("doc_id", "text").mapInArrow(rows, _DDL)
