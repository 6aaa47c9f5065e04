"""Licence notices in texts, by conditional compression.

Windows of a block, as long as a template, are compressed alone and with the template as a raw
zstandard dictionary. Where that saves most of the bytes that it saves on the template itself, whatever the
length of the block, the template is a candidate; candidates are ranked by what they save, and the winner of
each place is confirmed or refused by the exact differences of its wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from controlweave.llm.tables import batch, decoded, payloads, prepared

#: Wordings of public licences and their notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ),
    "MIT-0": (
        "Licensed under the MIT No Attribution License.",
        "Licensed under the MIT-0 License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Lines that may belong to a notice.
CUES = (
    r"(?i)licen[sc]|copyright|\(c\)|©|permission|redistribut|public domain|warrant|creative commons|\bcc[ -](by|0)|"
    r"\bgpl|free software|without limitation|liab|disclaimer|lizenz|licencia|unencumbered|spdx|mozilla"
)
#: Lines without a cue that a block may bridge.
BRIDGED = 2
#: Share of a template's words that must stand in the block in order, and of those without which a
#: window is not compressed at all.
LEAST_WORDS, WORTH_COMPRESSING = 0.85, 0.5
#: Share of the bytes saved on the template itself that a window must save.
LEAST_SAVED = 0.6
#: Words that make another licence of a template (fixed values); one more or one less refuses the template.
DISTINGUISHING: dict[str, frozenset[str]] = {
    name: frozenset(words.split())
    for name, words in {
        "MIT": "0 no attribution x11", "MIT-0": "0 no attribution", "BSD-2-Clause": "patent clear neither endorse", "BSD-3-Clause": "patent clear nuclear",
        "Apache-2.0": "exception exceptions", "GPL-2.0": "affero lesser library", "GPL-3.0": "affero lesser library", "LGPL-2.1": "affero lesser",
        "LGPL-3.0": "affero lesser", "AGPL-3.0": "affero lesser", "CC-BY-4.0": "nc sa nd noncommercial sharealike noderivatives noderivs",
        "CC-BY-SA-4.0": "nc sa nd noncommercial sharealike noderivatives noderivs", "CC-BY-NC-4.0": "nc sa nd noncommercial sharealike noderivatives noderivs",
    }.items()
}
#: Words that deny a notice, within it or up to so many words before (fixed values).
DENIALS, DENIED_BEFORE = frozenset("not never isn aren wasn cannot neither unlike without".split()), 3
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Notice:
    """A template found in a block."""

    licence: str | None
    reduction: float
    exact: bool
    missing: tuple[str, ...] = ()
    added: tuple[str, ...] = ()


def blocks(text: str, cue: re.Pattern, bridged: int = BRIDGED) -> list[tuple[int, list[str]]]:
    """Runs of lines with cues, few others between: (first line, lines)."""
    lines = text.split("\n")
    marked = [i for i, line in enumerate(lines) if cue.search(line)]
    out: list[tuple[int, list[str]]] = []
    begin = end = None
    for i in marked:
        if begin is not None and i - end <= bridged + 1:
            end = i
            continue
        if begin is not None:
            out.append((begin, lines[begin : end + 1]))
        begin = end = i
    if begin is not None:
        out.append((begin, lines[begin : end + 1]))
    return out


class Template:
    """A wording as words and as a raw dictionary; ``best`` is what the dictionary saves on the wording itself."""

    def __init__(self, licence: str, wording: str, level: int) -> None:
        self.licence, self.words = licence, [w.lower() for w in _WORD.findall(wording)]
        self.own, text = set(self.words), " ".join(self.words).encode()
        make = lambda **k: zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False, **k)
        self.plain = make()
        self.given = make(dict_data=zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.best = self.saved(self.words)[0]
        #: Words that a notice may have in all, and between windows tried.
        self.span, self.stride = len(self.words) + int((1 - LEAST_WORDS) * len(self.words) + 1), max(1, len(self.words) // 8)

    def saved(self, words: list[str | None]) -> tuple[int, int]:
        """Bytes that the dictionary saves on a window, and those the window takes alone."""
        text = " ".join(w or "" for w in words).encode()
        alone = len(self.plain.compress(text))
        return alone - len(self.given.compress(text)), alone


@dataclass(frozen=True)
class Candidate:
    """A window that a template explains; the best of its neighbours."""

    rank: int
    template: int
    begin: int
    reduction: float


class Scanner:
    """Holds blocks against all templates; what it found for a block is remembered."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], level: int = 3) -> None:
        self.known: dict[str, list[Notice]] = {}
        self.templates = [Template(name, wording, level) for name, wordings in templates.items() for wording in wordings]

    def scan(self, block: str) -> list[Notice]:
        """Notices in the block, best first; one without a licence if none is confirmed."""
        if block not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            self.known[block] = self._scan(block)
        return self.known[block]

    def _candidates(self, k: int, words: list[str | None], begin: int = 0, end: int | None = None) -> list[Candidate]:
        """The windows of words begin to end that the template's dictionary makes small enough."""
        t = self.templates[k]
        end = len(words) if end is None else end
        here = words[begin:end]
        counts = np.concatenate([[0], np.cumsum([w in t.own for w in here])])
        starts = np.arange(0, max(1, len(here) - len(t.words) + t.stride), t.stride)
        held = counts[np.minimum(starts + t.span, len(here))] - counts[starts]
        out: list[Candidate] = []
        for start in starts[held >= WORTH_COMPRESSING * len(t.words)].tolist():
            saved, alone = t.saved(here[start : start + t.span])
            if saved >= LEAST_SAVED * t.best:
                # what the dictionary saves, less what it holds besides
                new = Candidate(2 * saved - t.best, k, begin + start, saved / alone)
                if out and new.begin - out[-1].begin <= len(t.words) // 2:
                    if new.rank > out[-1].rank:
                        out[-1] = new
                else:
                    out.append(new)
        return out

    def _scan(self, block: str) -> list[Notice]:
        words: list[str | None] = [w.lower() for w in _WORD.findall(block)]
        found = [c for k in range(len(self.templates)) for c in self._candidates(k, words)]
        most = max((c.reduction for c in found), default=0.0)
        chosen: dict[int, tuple[Candidate, Match]] = {}
        while found:
            winner = max(found, key=lambda c: (c.rank, -c.template, -c.begin))
            found.remove(winner)
            t = self.templates[winner.template]
            begin = max(0, winner.begin - len(t.words) // 2)
            match = _differences(t.words, words[begin : winner.begin + t.span + len(t.words) // 2], begin)
            if match is None or _refused(t.licence, match, words):
                continue
            chosen.setdefault(winner.template, (winner, match))
            # the winner takes its words; what lay over them is compressed again without
            words[match.begin : match.end] = [None] * (match.end - match.begin)
            again = {c.template for c in found if c.begin < match.end and match.begin < c.begin + self.templates[c.template].span} | {winner.template}
            found = [c for c in found if c.template not in again] + [c for k in sorted(again) for c in self._candidates(k, words)]
        if not chosen:
            return [Notice(None, most, False)]
        ranked = sorted(chosen.values(), key=lambda x: (-x[0].rank, x[0].template))
        return [Notice(self.templates[c.template].licence, c.reduction, not m.missing and not m.added, m.missing, m.added) for c, m in ranked]


def _refused(licence: str, match: Match, words: list[str | None]) -> bool:
    """Whether the differences make another licence, or none, of the wording."""
    differing = {*match.missing, *match.added}
    if differing & (DISTINGUISHING.get(licence, frozenset()) | DENIALS):
        return True
    # a number more is another version, unless it is a year
    if any(w.isdigit() and len(w) < 4 for w in match.added):
        return True
    return any(w in DENIALS for w in words[max(0, match.begin - DENIED_BEFORE) : match.begin])


@dataclass(frozen=True)
class Match:
    """Where a template's words stand in a block: the span, and the words it lacks or has between."""

    begin: int
    end: int
    #: Words agreed on, less those that differ.
    worth: int
    missing: tuple[str, ...]
    added: tuple[str, ...]


def _differences(wanted: list[str], words: list[str | None], at: int) -> Match | None:
    """Words of the template that the window lacks, and words it has between; None if too few agree."""
    matcher = SequenceMatcher(None, wanted, words, autojunk=False)
    if matcher.quick_ratio() * (len(wanted) + len(words)) / 2 < LEAST_WORDS * len(wanted):
        return None
    same = [m for m in matcher.get_matching_blocks() if m.size]
    agreed = sum(m.size for m in same)
    if agreed < LEAST_WORDS * len(wanted):
        return None
    numbers = {w for w in wanted if w.isdigit()}
    present = {w for m in same for w in wanted[m.a : m.a + m.size]}
    if not numbers <= present:  # another version is another licence
        return None
    first, last = same[0], same[-1]
    begin, end = first.b, last.b + last.size
    kept_a = {i for m in same for i in range(m.a, m.a + m.size)}
    kept_b = {i for m in same for i in range(m.b, m.b + m.size)}
    missing = tuple(w for i, w in enumerate(wanted) if i not in kept_a)
    between = [words[i] for i in range(begin, end) if i not in kept_b]
    if len(between) > (1 - LEAST_WORDS) * len(wanted) + 1:
        return None
    # words that another template took are not the block's to add
    added = tuple(w for w in between if w is not None)
    return Match(at + begin, at + end, agreed - len(missing) - len(between), missing, added)


_NOTICE = [
    ("first_line", pa.int32()), ("n_lines", pa.int32()), ("licence", pa.string()), ("reduction", pa.float64()), ("exact", pa.bool_()),
    ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("block", pa.string()),
]
_NOTICE_DDL = "first_line int, n_lines int, licence string, reduction double, exact boolean, missing array<string>, added array<string>, block string"


def notices(
    docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text", cues: str = CUES,
) -> DataFrame:
    """Licence notices: a row per block and licence found in it.

    The id, ``first_line`` and ``n_lines`` of the block, ``licence`` (null: a candidate block that
    no template explains), ``reduction`` (share by which the template shrinks the compressed
    window), ``exact``, the words ``missing`` and ``added``, and the ``block``. Null, empty and other
    texts without cues give no rows; repeated rows and null ids are kept; an empty table gives no
    rows; other columns are ignored. Texts without cues stay in the JVM; no shuffle.
    """
    prepared(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    own = docs.select(docs[id_column], docs[text_column].cast("string").alias("text")).where(F.col("text").rlike(cues))
    own = own.select(own[0], F.col("text").cast("binary"))
    given = dict(templates)

    def scan(batches) -> Iterator[pa.RecordBatch]:
        scanner, cue = Scanner(given), re.compile(cues)
        for part in batches:
            rows = []
            for i, data in enumerate(payloads(part.column(1))):
                for first, lines in blocks(decoded(data), cue):
                    block = "\n".join(lines)
                    rows += [(i, first, len(lines), n.licence, n.reduction, n.exact, n.missing, n.added, block) for n in scanner.scan(block)]
            if rows:
                at, *columns = zip(*rows, strict=True)
                schema = pa.schema([part.schema.field(0), *_NOTICE])
                yield batch(schema, [part.column(0).take(pa.array(at)), *columns])

    return own.mapInArrow(scan, f"`{id_column}` {kind}, {_NOTICE_DDL}")
