"""License scans by template-markup matching.

A template is the wording of a licence or of its usual notice, with markup for what
may differ: ``<<opt>> ... <</opt>>`` may be left out, ``<<var 1-6>>`` stands for one
to six words of any kind, ``<<alt a b|c>>`` for one of several wordings.  Every other
word is mandatory.  All templates are
compiled into one automaton over words, made deterministic as it is needed; a text
has a licence where some run of its words is accepted, that is where the mandatory
wording stands exactly, in order, with nothing between but what markup allows.  Texts
that lack the longest mandatory word of every template are not run through it.

Base phrases are found beside it, place by place, on the bytes of the whole text.

Defined cases: null text counts as empty, with no words, null places, empty labels
and score 0; repeated rows and ids are judged one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import license_texts

#: Phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_MIT_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<opt>>the<</opt>> <<var 1-8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>><<var 1-1>><</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>><<var 1-1>><</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "<<opt>><<var 1-1>><</opt>> neither the name of <<opt>>the<</opt>> <<var 1-8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = "this software is provided by <<opt>>the<</opt>> <<var 1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<opt>>the<</opt>> <<var 1-8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL_TERMS = "<<var 1-6>> is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>{kind}<</opt>> general public license as published by the free software foundation either version {version} of the license or at your option any later version"
_GPL_HOPE = "<<var 1-6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<opt>>{kind}<</opt>> general public license for more details"

#: Label: wording.  Case and punctuation do not count.
TEMPLATES = {
    # notices
    "mit-notice": "<<opt>>this <<var 1-4>> is<</opt>> released under the <<opt>>terms of the<</opt>> mit license",
    "apache-2.0": "licensed under the apache license <<opt>>version<</opt>> 2.0",
    "apache-2.0-notice": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<alt http|https>> www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-2.0": "<<opt>>this <<var 1-4>> is<</opt>> licensed under the <<opt>>terms of the<</opt>> gnu general public license <<alt 2|version 2|v2|v 2>>",
    "gpl-3.0": "<<opt>>this <<var 1-4>> is<</opt>> licensed under the <<opt>>terms of the<</opt>> gnu general public license <<alt 3|version 3|v3|v 3>>",
    "gpl-2.0-or-later-notice": _GPL_TERMS.format(kind="library", version="2") + " " + _GPL_HOPE.format(kind="library"),
    "gpl-3.0-or-later-notice": _GPL_TERMS.format(kind="affero", version="3") + " " + _GPL_HOPE.format(kind="affero"),
    "gpl-redistribution": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation <<opt>>either version <<var 1-3>> of the license or <<opt>>at your option<</opt>> any later version<</opt>>",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at <<alt http|https>> <<opt>>www<</opt>> mozilla org mpl 2.0",
    "cc-by-4.0": "licensed under <<opt>><<alt a|the>><</opt>> <<opt>>creative commons<</opt>> <<alt cc by|attribution>> 4.0 <<opt>>international<</opt>>",
    "cc-by-sa-4.0": "licensed under <<opt>><<alt a|the>><</opt>> <<opt>>creative commons<</opt>> <<alt cc by sa|attribution sharealike>> 4.0 <<opt>>international<</opt>>",
    "cc-by-nc-4.0": "licensed under <<opt>><<alt a|the>><</opt>> <<opt>>creative commons<</opt>> <<alt cc by nc|attribution noncommercial>> 4.0 <<opt>>international<</opt>>",
    "cc0-1.0": "<<opt>>released<</opt>> under <<opt>>the<</opt>> cc0 <<opt>>1.0<</opt>> <<opt>>universal<</opt>> <<opt>>cc0 1.0<</opt>> public domain dedication",
    # whole licences
    "mit-text": f"{_MIT_GRANT} subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software {_MIT_DISCLAIMER}",
    "mit-0-text": f"{_MIT_GRANT} {_MIT_DISCLAIMER}",
    "isc-text": "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<opt>>the<</opt>> <<var 1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<opt>>the<</opt>> <<var 1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": f"{_BSD_START} {_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{_BSD_START} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "apache-2.0-text": license_texts.template(license_texts.APACHE_2_0),
    "gpl-2.0-text": license_texts.template(license_texts.GPL_2_0),
    "gpl-3.0-text": license_texts.template(license_texts.GPL_3_0),
    "mpl-2.0-text": license_texts.template(license_texts.MPL_2_0),
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<opt>>2<</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt>>3<</opt>> this notice may not be removed or altered from any source distribution",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsl-1.0-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = rb"[0-9a-z\x80-\xff]"
_GAP = rb"[^0-9a-z\x80-\xff]+"
WORDS = re.compile(_WORD + rb"+")
PLACES = re.compile(rb"(?<!" + _WORD + rb")(?=(" + b"|".join(_GAP.join(map(str.encode, p.split())) for p in BASE) + rb")(?!" + _WORD + rb"))")
_MARKUP = re.compile(r"<<opt>>|<</opt>>|<<var (\d+)-(\d+)>>|<<alt ([^<>]*)>>|[0-9a-z]+")


class Either(list):
    """Wordings, one of which must stand."""


def parse(template: str) -> list:
    """Words, ("var", least, most), ``Either`` and nested lists for optional regions."""
    stack: list[list] = [[]]
    for m in _MARKUP.finditer(template.lower()):
        if m[0] == "<<opt>>":
            stack.append([])
        elif m[0] == "<</opt>>":
            region = stack.pop()
            stack[-1].append(region)
        elif m[3] is not None:
            stack[-1].append(Either(parse(way) for way in m[3].split("|")))
        else:
            stack[-1].append(("var", int(m[1]), int(m[2])) if m[1] else m[0].encode())
    if len(stack) > 1:
        raise ValueError(f"an optional region is not closed: {template}")
    return stack[0]


def needed(templates: dict[str, str]) -> re.Pattern | None:
    """Finds the longest mandatory word of any of the templates; None if one has no mandatory word."""
    longest = [max((x for x in parse(t) if isinstance(x, bytes)), key=lambda w: (len(w), w), default=b"") for t in templates.values()]
    return re.compile(b"|".join(sorted(map(re.escape, set(longest))))) if all(longest) else None


class TokenAutomaton:
    """Templates over words: a nondeterministic automaton, with its subsets made as texts need them."""

    MOST_STATES = 100_000

    def __init__(self, templates: dict[str, str]):
        self.moves: list[list[tuple[bytes | None, int]]] = []  # None: any word
        self.skips: list[list[int]] = []
        self.ends: dict[int, str] = {}
        starts = []
        for label, text in templates.items():
            first = self._state()
            starts.append(first)
            self.ends[self._chain(parse(text), first)] = label
        self.alphabet = {w: i for i, w in enumerate(sorted({w for m in self.moves for w, _ in m if w}), 1)}
        self.start = self._closure(starts)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.sets, self.labels, self.next = {}, [], [], []
        self._number(self.start)

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _chain(self, items: list, at: int) -> int:
        for x in items:
            if isinstance(x, Either):
                out = self._state()
                for way in x:
                    self.skips[self._chain(way, at)].append(out)
                at = out
            elif isinstance(x, list):
                end = self._chain(x, at)
                out = self._state()
                self.skips[at].append(out)
                self.skips[end].append(out)
                at = out
            elif isinstance(x, tuple):
                ways = [at] if x[1] == 0 else []
                for k in range(1, x[2] + 1):
                    new = self._state()
                    self.moves[at].append((None, new))
                    at = new
                    if k >= x[1]:
                        ways.append(at)
                at = self._state()
                for s in ways:
                    self.skips[s].append(at)
            else:
                new = self._state()
                self.moves[at].append((x, new))
                at = new
        return at

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in seen:
                seen.add(s)
                todo += self.skips[s]
        return frozenset(seen)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.labels.append(frozenset(self.ends[s] for s in states if s in self.ends))
            self.next.append({})
        return self.numbers[states]

    def accepted(self, words: list[bytes]) -> set[str]:
        """Labels of the templates that some run of the words matches."""
        if len(self.sets) > self.MOST_STATES:
            self.forget()
        found: set[str] = set()
        symbols, nexts, labels, at = self.alphabet, self.next, self.labels, 0
        for w in words:
            x = symbols.get(w, 0)
            to = nexts[at].get(x)
            if to is None:
                reached = {t for s in self.sets[at] for v, t in self.moves[s] if v is None or v == w}
                to = nexts[at][x] = self._number(self._closure(reached) | self.start)
            at = to
            if labels[at]:
                found |= labels[at]
        return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _n_words(texts: pa.Array) -> np.ndarray:
    """Words of each text, from the bytes of the batch at once."""
    flat = texts.cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if flat.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lowered = WORD_BYTE | np.isin(np.arange(256), np.arange(0x41, 0x5B))
    inside = lowered[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    total = np.concatenate([[0], np.cumsum(first)])
    return total[offsets[1:]] - total[offsets[:-1]]


def scanner(templates: dict[str, str]):
    def scan(batches):
        automaton = TokenAutomaton(templates)
        own_words, base_words = needed(templates), needed({p: p for p in BASE})
        label_of = {re.sub(_GAP, b" ", k.encode()): v for k, v in BASE.items()}
        for batch in batches:
            texts = batch.column("text").fill_null("")
            n_words = _n_words(texts)
            rows = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for text in texts.cast(pa.large_binary()):
                low = text.as_buffer().to_pybytes().lower()
                n, first, last, base, own = 0, None, None, set(), set()
                words = None
                if base_words.search(low):
                    if places := [(m.start(), m[1]) for m in PLACES.finditer(low)]:
                        words = list(WORDS.finditer(low))
                        starts = np.fromiter((m.start() for m in words), np.int64, len(words))
                        at = np.searchsorted(starts, [p for p, _ in places])
                        n, first, last = len(places), int(at.min()), int(at.max())
                        base = {label_of[re.sub(_GAP, b" ", m)] for _, m in places}
                if own_words is None or own_words.search(low):
                    own = automaton.accepted([m[0] for m in words] if words else WORDS.findall(low))
                rows["n_base"].append(n)
                rows["first_word"].append(first)
                rows["last_word"].append(last)
                rows["base_labels"].append(",".join(sorted(base)))
                rows["labels"].append(",".join(sorted(base | own)))
                rows["score"].append(1.0 if own else 0.5 if base else 0.0)
            kinds = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64())} | {k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return scan


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text).  score: 1 a template matches, 0.5 a base phrase alone, else 0."""
    return docs.select("doc_id", "text").mapInArrow(scanner(templates), SCHEMA)


def op5_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _pattern(items: list) -> str:
    """A template as a regular expression over words that each follow a space."""
    part = lambda x: f"(?:{'|'.join(map(_pattern, x))})" if isinstance(x, Either) else f"(?:{_pattern(x)})?" if isinstance(x, list) else f"(?: [^ ]+){{{x[1]},{x[2]}}}" if isinstance(x, tuple) else " " + x.decode()
    return "".join(map(part, items))


def sql(templates: dict[str, str] = TEMPLATES) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = lambda phrase: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))
    lists = ", ".join(f"list_filter(range(0, len(w)), lambda i: {at(p)}) AS p{k}" for k, p in enumerate(BASE))
    names = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in pairs) + "], lambda x: x IS NOT NULL)"
    base = [(label, f"len(p{k}) > 0") for k, label in enumerate(BASE.values())]
    own = [(label, f"regexp_matches(t, '{_pattern(parse(text))} ')") for label, text in templates.items()]
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {lists} FROM a),
c AS (SELECT doc_id, len(w) AS n_words, list_concat(p0, p1, p2, p3) AS p, {names(base)} AS bl, {names(own)} AS ol FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
       array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, ol))), ',') AS labels,
       CASE WHEN len(ol) > 0 THEN 1.0::DOUBLE WHEN len(bl) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM c
"""
