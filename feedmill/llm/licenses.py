"""License scans: template markup compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import small_batches

# The base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public licenses, headers and notices. [[ ]] encloses what may be missing, {{n m regex}} stands
# for n to m words that each match the regex whole (any word if it is left out). Labels that end in -header or -notice
# name what points at a license; the others stand for a license's whole text.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": """Licensed under the Apache License, Version {{2 2 [0-9]+}} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        {{3 12}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1.]] Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY {{1 12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{1 12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1.]] Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. [[3.]] Neither the name of {{1 12}} nor the names of [[its]] {{0 4}} contributors may be used to endorse or promote products derived
        from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY {{1 12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{1 12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
        NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-nc": "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY-NC [[{{2 2 [0-9]+}}]]",
    "cc-by-sa": "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY-SA [[{{2 2 [0-9]+}}]]",
    "cc0-notice": "To the extent possible under law, {{1 12}} waived all copyright and related or neighboring rights to {{1 12}}",
    "copyright": "Copyright (c) {{1 1 [0-9]{4}}}",
    "gpl-header": """{{1 4}} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {{1 1 [0-9]+}} of the
        License, or (at your option) any later version. {{1 4}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "agpl-header": """{{1 4}} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version {{1 1 [0-9]+}}
        of the License, or (at your option) any later version. {{1 4}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
        A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "lgpl-header": """{{1 4}} is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[[;]] either version
        {{1 2 [0-9]+}} of the License, or (at your option) any later version. {{1 4}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "gpl-notice": "[[This]] [[{{1 3}}]] is licensed under the GNU General Public License, version {{1 1 [0-9]+}}",
    "isc": """Permission to use, copy, modify, [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{1 8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{1 8}} BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
        OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-notice": "Released under the MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{1 12}} BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {{3 8}}",
    "spdx": "SPDX-License-Identifier: {{1 4}}",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
        in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1.]] The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2.]]
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[3.]] This notice may not be removed or altered from any source distribution.""",
}

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+) (\d+)(?: (.*?))?\}\}(?!\})|[^\[\]{}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """States of a template: what each may read and where it goes, with free jumps over optional regions closed.

    Sets of states are determinised when they are first met: the next set depends on the set and the word,
    and words that no state names and no regex takes share one entry.
    """

    def __init__(self, template: str):
        self.reads: list[list[tuple[object, int]]] = [[]]  # of each state: (word or regex or None for any, next state)
        self.jumps: list[set[int]] = [set()]
        opened: list[int] = []
        at = 0
        for found in _MARK.finditer(template):
            part = found[0]
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.jumps[opened.pop()].add(at)
            elif part.startswith("{{"):
                kind = re.compile(found[3]) if found[3] else None
                low, high = int(found[1]), int(found[2])
                skips = []
                for n in range(high):
                    if n >= low:
                        skips.append(at)
                    at = self._read(at, kind)
                for state in skips:
                    self.jumps[state].add(at)
            else:
                for word in words_of(part):
                    at = self._read(at, word)
        if opened:
            raise ValueError("optional region without end")
        self.last = at
        self.words = {k for state in self.reads for k, _ in state if isinstance(k, str)}
        self.start = self._closed({0})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}

    def _read(self, state: int, what: object) -> int:
        self.reads.append([])
        self.jumps.append(set())
        self.reads[state].append((what, len(self.reads) - 1))
        return len(self.reads) - 1

    def _closed(self, states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for state in self.jumps[todo.pop()] - out:
                out.add(state)
                todo.append(state)
        return frozenset(out)

    def first_words(self) -> set[str] | None:
        """Words that may begin a match, None if any word may."""
        reads = [k for s in self.start for k, _ in self.reads[s]]
        return {k for k in reads if isinstance(k, str)} if all(isinstance(k, str) for k in reads) else None

    def step(self, states: frozenset, word: str) -> frozenset:
        named = word in self.words
        regexes = not named and any(isinstance(k, re.Pattern) for s in states for k, _ in self.reads[s])
        key = (states, word if named or regexes else "")
        if key not in self.moves:
            after = {n for s in states for k, n in self.reads[s] if k is None or k == word or (isinstance(k, re.Pattern) and k.fullmatch(word))}
            if len(self.moves) > 20_000:
                self.moves.clear()
            self.moves[key] = self._closed(after)
        return self.moves[key]

    def match(self, words: list[str], at: int) -> int:
        """End of the longest match that begins at a place, -1 if none does."""
        states, best = self.start, -1
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.last in states:
                best = i + 1
        return best


class Scanner:
    """All templates and base phrases; words that begin one lead to it."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE):
        self.phrases: dict[str, list[tuple[list[str], str]]] = {}
        for phrase, label in base.items():
            split = phrase.split(" ")
            self.phrases.setdefault(split[0], []).append((split, label))
        self.begins: dict[str, list[tuple[str, Automaton, int]]] = {}
        for label, template in templates.items():
            automaton = Automaton(template)
            firsts = automaton.first_words()
            if firsts is not None:
                for word in firsts:
                    self.begins.setdefault(word, []).append((label, automaton, 0))
            else:  # the first word that must stand as it is leads back to where a match may begin
                word, back = self._anchor(template)
                self.begins.setdefault(word, []).append((label, automaton, back))
        self.known = self.phrases.keys() | self.begins.keys()

    @staticmethod
    def _anchor(template: str) -> tuple[str, int]:
        """First mandatory word of a template, and the most words that may stand before it."""
        depth = before = 0
        for found in _MARK.finditer(template):
            if found[0] in ("[[", "]]"):
                depth += 1 if found[0] == "[[" else -1
            elif found[0].startswith("{{"):
                before += int(found[2])
            elif depth and words_of(found[0]):
                before += len(words_of(found[0]))
            elif words_of(found[0]):
                return words_of(found[0])[0], before
        raise ValueError("template without mandatory words")

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Number of words, base places (word, label), template matches (first word, end, label)."""
        words = words_of(text)
        known, base, found = self.known, [], {}
        for at in [i for i, w in enumerate(words) if w in known]:
            for phrase, label in self.phrases.get(words[at], ()):
                if words[at : at + len(phrase)] == phrase:
                    base.append((at, label))
            for label, automaton, back in self.begins.get(words[at], ()):
                for start in range(max(0, at - back), at + 1):
                    end = automaton.match(words, start)
                    if end > at:
                        found[label, end] = min(start, found.get((label, end), start))
                        break
        return len(words), base, sorted((start, end, label) for (label, end), start in found.items())


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, with_matches: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row's whole text; on request the template matches.

    score: 1 if a template accepts a passage, else 0.5 if a base phrase stands in the text, else 0. A null text is
    empty: no words, null places, empty labels. Rows are independent: repeated rows repeat, other columns are
    ignored, an empty table gives an empty result.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, base, found = scanner.scan(text.as_py())
                own = {label for _, label in base}
                every = own | {label for *_, label in found}
                places = [at for at, _ in base]
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(every)), 1.0 if found else 0.5 if base else 0.0, [{"first": a, "end": b, "label": c} for a, b, c in found]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            take = 8 if with_matches else 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(take))], ["doc_id", *names[:take]])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", matches array<struct<first:long,end:long,label:string>>" * with_matches
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
