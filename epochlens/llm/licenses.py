"""License scans: template markup compiled to token automata.

A template is a word list with two kinds of markup: ``[[ ... ]]`` may be left out, ``{{n}}`` stands
for up to n words of any kind. Compilation gives a small automaton over words; a text is accepted where a
run of its words follows the automaton from start to end, so all mandatory wording matches exactly. Templates begin with
mandatory words; these are searched as a plain byte string, and the automaton runs from each place where they stand, once the template's longest
mandatory run was found at all.

Most templates are whole license texts, with the holder replaceable and the disclaimer mandatory, or whole notices. Those of ``PARTS`` are the
grants of the texts alone: they label a text that goes on otherwise, with a lower score.

Defined cases: null or empty text has no words, no labels, score 0; very long texts are scanned whole, in time that grows with their length;
null ids stay null; equal places count once for each phrase; repeated rows each give their row; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_values, slices, small_batches

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_AS_IS = "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
_ISC = "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_ZLIB = "this software is provided as is without any express or implied warranty in no event will {{4}} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
_UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"

# Wording of public license texts and of the notices that name them.
TEMPLATES = {
    "mit-text": f"{_MIT} the software is provided as is without warranty of any kind express or implied {_AS_IS}",
    "isc-text": f"{_ISC} the software is provided as is and {{{{6}}}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{{{6}}}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-text": f"{_BSD} {_BSD_END}",
    "bsd-3-text": f"{_BSD} [[3]] [[c]] neither the name of {{{{12}}}} may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "zlib-text": f"{_ZLIB} [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "unlicense-text": f"{_UNLICENSE} in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied {_AS_IS}",
    "boost-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall {{12}} be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{2}} of the license or at your option any later version {{3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "lgpl-header": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {{2}} of the license or at your option any later version {{3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-2.0": "licensed under the [[terms of the]] gnu general public license [[v]] [[version]] 2",
    "gpl-3.0": "licensed under the [[terms of the]] gnu general public license [[v]] [[version]] 3",
    "cc-by-4.0": "licensed under [[a]] [[the]] cc by 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] cc by sa 4 0",
    "mit-notice": "released under the [[terms of the]] mit license",
}
#: Label of a part, the template that it is a part of, and its wording. The label stands only where the template is not accepted.
PARTS = {"mit-grant": ("mit-text", _MIT), "isc-grant": ("isc-text", _ISC), "zlib-grant": ("zlib-text", _ZLIB), "unlicense-grant": ("unlicense-text", _UNLICENSE), "bsd-grant": ("bsd-2-text", _BSD)}
SCORES = {"template": 1.0, "part": 0.75, "phrase": 0.5}

# Words are runs of bytes other than these, so letters A-Z are lowered and other bytes become blanks.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Automaton:
    """``steps[i]`` is a word or an int (so many free words at most); ``skips[i]`` are steps reachable for nothing. ``lead`` are the words
    that every accepted run begins with."""

    label: str
    steps: tuple
    skips: tuple
    probe: bytes
    lead: bytes

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether the words from ``start`` follow the automaton to its end."""
        end = len(self.steps)
        seen, active = set(), [(0, 0)]
        i = start
        while active:
            closed, todo = set(), list(active)
            while todo:
                state = todo.pop()
                if state in closed:
                    continue
                closed.add(state)
                at, used = state
                if at == end:
                    return True
                todo += [(to, 0) for to in self.skips[at]]
            active = []
            if i == len(words):
                return False
            for at, used in closed:
                step = self.steps[at]
                if isinstance(step, int):
                    if used < step:
                        active.append((at, used + 1))
                elif step == words[i]:
                    active.append((at + 1, 0))
            i += 1
        return False


def compile_template(label: str, markup: str) -> Automaton:
    """Parse the markup; optional regions may not nest."""
    steps: list = []
    opened, regions, runs, run = None, [], [], []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        if token == "[[":
            opened, run = len(steps), []
        elif token == "]]":
            regions.append((opened, len(steps)))
            opened, run = None, []
        elif token.startswith("{{"):
            steps.append(int(token[2:-2]))
            run = []
        else:
            steps.append(token.encode())
            if opened is None:
                run = [*run, token]
                runs.append(run)
    skips = [[] for _ in steps]
    for begin, end in regions:
        skips[begin].append(end)
    for at, step in enumerate(steps):
        if isinstance(step, int):
            skips[at].append(at + 1)
    if not runs or markup.lstrip()[:2] in ("[[", "{{"):
        raise ValueError("a template begins with words that it demands")
    lead = re.split(r"\[\[|\{\{", markup)[0].split()
    return Automaton(label, tuple(steps), tuple(map(tuple, skips)), f" {' '.join(max(runs, key=len))} ".encode(), f" {' '.join(lead)} ".encode())


def _places(joined: bytes, needle: bytes):
    at = joined.find(needle)
    while at >= 0:
        yield at
        at = joined.find(needle, at + 1)


def scan_text(data: bytes, automata: list[Automaton], phrases: list[tuple[bytes, str]], parts: dict[str, str] | None = None) -> tuple:
    """Columns of ``SCHEMA`` after doc_id for one text. ``parts`` gives the template of which a label is a part."""
    words = data.translate(_TABLE).split()
    joined = b" " + b" ".join(words) + b" "
    starts: list[np.ndarray] = []

    def number(at: int) -> int:
        if not starts:
            starts.append(np.cumsum([0, *(len(w) + 1 for w in words)]))
        return int(np.searchsorted(starts[0], at))

    places, base = [], set()
    for phrase, label in phrases:
        found = [number(at) for at in _places(joined, phrase)]
        places += found
        base |= {label} if found else set()
    accepted = {a.label for a in automata if a.probe in joined and any(a.accepts(words, number(at)) for at in _places(joined, a.lead))}
    partly = {x for x in accepted if x in (parts or {})}
    accepted -= partly
    partly = {x for x in partly if parts[x] not in accepted}
    score = SCORES["template"] if accepted else SCORES["part"] if partly else SCORES["phrase"] if base else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | accepted | partly)), score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document with the base phrase places, the accepted templates and a score.

    score is 1 where a template is accepted, 0.75 where only a part of one is, 0.5 where only a base phrase stands, else 0.
    """
    small_batches(docs)
    wording = TEMPLATES | {k: v for k, (_, v) in PARTS.items()} if templates is None else templates
    automata = [compile_template(k, v) for k, v in wording.items()]
    parts = {k: v for k, (v, _) in PARTS.items()} if templates is None else {}
    phrases = [(f" {k} ".encode(), v) for k, v in BASE_PHRASES.items()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scan(batches):
        for batch in slices(batches, rows=2048, max_bytes=16 << 20):
            rows = [scan_text(t, automata, phrases, parts) for t in byte_values(batch.column(1))]
            columns = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def _template_regex(markup: str) -> str:
    """The template as a regular expression over words joined by blanks, for the SQL side."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        out += "(?:" if token == "[[" else ")?" if token == "]]" else f"(?: [^ ]+){{0,{token[2:-2]}}}" if token.startswith("{{") else f" {token}"
    return out + " "


def oracle_sql(docs: str = "documents") -> str:
    """DuckDB SQL for ``scan_licenses`` over a table."""
    at = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()}) AS p{k}" for k, p in enumerate(BASE_PHRASES))
    n = range(len(BASE_PHRASES))
    every = " || ".join(f"p{k}" for k in n)
    base = "[" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{v}' END" for k, v in enumerate(BASE_PHRASES.values())) + "]"
    more = "[" + ", ".join(f"CASE WHEN regexp_matches(t, '{_template_regex(m)}') THEN '{k}' END" for k, m in TEMPLATES.items()) + "]"
    part = "[" + ", ".join(f"CASE WHEN regexp_matches(t, '{_template_regex(m)}') AND NOT regexp_matches(t, '{_template_regex(TEMPLATES[w])}') THEN '{k}' END" for k, (w, m) in PARTS.items()) + "]"
    return rf"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {at} FROM a),
c AS (SELECT doc_id, len(w) AS n_words, {every} AS places, list_filter({base}, lambda x: x IS NOT NULL) AS base, list_filter({more}, lambda x: x IS NOT NULL) AS more,
  list_filter({part}, lambda x: x IS NOT NULL) AS part FROM b)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || more || part)), ',') AS labels, CASE WHEN len(more) > 0 THEN 1.0 WHEN len(part) > 0 THEN 0.75 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM c
"""
