"""License scans by a generalised suffix automaton.

The automaton holds the tokens of all licence templates. Texts are streamed through it: at each token it knows the
longest match that ends there (the matching statistics). Matches that can't be extended are chained, in the order of both
text and template, into the span of the text that a template covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Words, hashed_words, pick, slices, utf8

#: Tokens of the shortest match, of the longest gap inside a chain, and of a chain that is enough whatever the template's size.
LEAST_MATCH, MOST_GAP, ENOUGH = 4, 12, 24
#: Part of a template shorter than ENOUGH tokens that a chain must match.
LEAST_COVER = 0.8

#: Notices and texts by which files are licensed.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT license", "Distributed under the terms of the MIT License",
        "Permission is hereby granted, free of charge, to any person "
        "obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License v2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero "
        "General Public License for more details. You should have received a copy of the GNU Affero General Public License "
        "along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) "
        "any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ],
    "ISC": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    ],
}


class Automaton:
    """Generalised suffix automaton over sequences of token ids, with the places in the sequences where each state ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for i, token in enumerate(seq):
                last = self._extend(last, token, ends)
                ends[last].append((k, i + 1))
        # a state's places are its own and those of the states whose suffix link it is
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                ends[self.link[v]] += ends[v]
        self.ends = [sorted(set(e)) if self.len[v] >= LEAST_MATCH else [] for v, e in enumerate(ends)]

    def _new(self, length: int, link: int, after: dict[int, int], ends: list) -> int:
        self.next.append(after)
        self.link.append(link)
        self.len.append(length)
        ends.append([])
        return len(self.len) - 1

    def _clone(self, p: int, q: int, token: int, ends: list) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, token: int, ends: list) -> int:
        q = self.next[p].get(token)
        if q is not None:
            return q if self.len[q] == self.len[p] + 1 else self._clone(p, q, token, ends)
        new = self._new(self.len[p] + 1, 0, {}, ends)
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, token, ends)
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each token."""
        out, state, length = [], 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if t in self.next[state]:
                state = self.next[state][t]
                length += 1
            out.append((length, state))
        return out


class Scanner:
    """Finds spans of templates ({licence: [texts]}) in texts."""

    def __init__(self, templates: dict[str, list[str]] | None = None):
        named = [(name, t) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts]
        self.names = [name for name, _ in named]
        hashed = [self._tokens(t) for _, t in named]
        self.vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
        sequences = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.sizes = [len(s) for s in sequences]
        self.machine = Automaton(sequences)

    @staticmethod
    def _tokens(text: str) -> np.ndarray:
        data, offsets = utf8(pa.array([text]))
        return Words(data, offsets).hashes()

    def _enough(self, k: int) -> float:
        return min(ENOUGH, LEAST_COVER * self.sizes[k])

    def _matches(self, ids: list[int], base: int) -> list[tuple[int, int, int, int]]:
        """(template, stop in it, stop in the text, length) of the matches that no token extends."""
        stats = self.machine.statistics(ids)
        out = []
        for i, (length, state) in enumerate(stats):
            if length >= LEAST_MATCH and (i + 1 == len(stats) or stats[i + 1][0] <= length):
                out += [(k, end, base + i + 1, length) for k, end in self.machine.ends[state]]
        return out

    def _chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(matched tokens, start, stop, template) of the best chain of each group of near matches of a template."""
        by: dict[int, list] = {}
        for k, end, stop, n in matches:
            by.setdefault(k, []).append((stop, end, n))
        found = []
        for k, own in by.items():
            own.sort()
            score, source = [n for _, _, n in own], [-1] * len(own)
            begin = [stop - n for stop, _, n in own]
            low = 0
            for j, (stop, end, n) in enumerate(own):
                while own[low][0] < stop - n - MOST_GAP - self.sizes[k]:
                    low += 1
                for i in range(low, j):
                    s, e, _ = own[i]
                    # an overlap in either counts once
                    new = min(n, stop - s, end - e)
                    if new > 0 and stop - n - s <= MOST_GAP and score[i] + new > score[j]:
                        score[j], source[j], begin[j] = score[i] + new, i, begin[i]
            used = set(source)
            for j, (stop, _, _) in enumerate(own):
                if score[j] >= self._enough(k) and j not in used:
                    found.append((score[j], begin[j], stop, k))
        return found

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str, int, float]]:
        """(row, start, stop in bytes of its text, licence, matched tokens, matched part of the template), in order."""
        words = Words(data, offsets)
        if not len(words.start) or not len(self.vocabulary):
            return []
        hashes = words.hashes()
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        # a word that no template has ends every match, so only runs of known words need the automaton
        edge = np.flatnonzero(known & np.append(True, ~known[:-1] | (words.row[1:] != words.row[:-1])))
        close = np.flatnonzero(known & np.append(~known[1:] | (words.row[1:] != words.row[:-1]), True)) + 1
        long = close - edge >= LEAST_MATCH
        by_row: dict[int, list] = {}
        for i, j in zip(edge[long].tolist(), close[long].tolist()):
            got = self._matches(ids[i:j].tolist(), i)
            if got:
                by_row.setdefault(int(words.row[i]), []).extend(got)
        out = []
        for row in sorted(by_row):
            chains = self._chains(by_row[row])
            # the template that matches most takes its words first; of equals the shorter template, then the first
            chains.sort(key=lambda c: (-c[0], self.sizes[c[3]], c[1], c[3]))
            taken: list[tuple[int, int]] = []
            for n, i, j, k in chains:
                if all(j <= a or i >= b for a, b in taken):
                    taken.append((i, j))
                    base = int(offsets[row])
                    part = round(min(1.0, n / self.sizes[k]), 4)
                    out.append((row, int(words.start[i]) - base, int(words.stop[j - 1]) - base, self.names[k], n, part))
        return sorted(out)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("coverage", T.DoubleType()),
])


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, start, stop, n_tokens, coverage): covered spans, in bytes of the text's UTF-8.

    A span is a chain of matches of 4 tokens or more with gaps of at most 12 that matches 24 tokens of a template, or
    80 % of a shorter one. Spans of a text don't overlap; where several templates match, the one with most matched tokens
    wins, of equals the one with the shorter template, then the earlier span, then the licence that comes first by name. Case and punctuation don't count. Null and empty texts have no span; rows with null or repeated ids are
    each scanned; whole texts are. An empty table gives an empty result; other columns are dropped. The automaton, of
    the templates' size, is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates))

    def run(batches):
        scanner = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                hits = scanner.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows, start, stop, name, n, part = zip(*hits) if hits else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(rows, pa.int64())), pa.array(name, pa.string()),
                        pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(n, pa.int32()), pa.array(part, pa.float64()),
                    ],
                    ["doc_id", "license", "start", "stop", "n_tokens", "coverage"],
                )

    return pick(docs, doc_id=id, text=text).mapInArrow(run, SCHEMA)
