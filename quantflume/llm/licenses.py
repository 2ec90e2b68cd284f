"""Licence scans: sparse TF-IDF cosines to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.llm.common import cut_lineage, fresh, schema_with, text_blocks

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_HEAD = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall
mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."""
_GPL_NOTICE = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU{1} General Public License as published by the Free Software
Foundation{2} version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU{1} General Public License for more details."""
_GPL_HEAD = """GNU{0} GENERAL PUBLIC LICENSE Version {1} Copyright (C) {2} Free Software Foundation, Inc.{3} Everyone is permitted to copy and distribute verbatim copies of this license
document, but changing it is not allowed."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""

#: Public licences' texts (those of files up to what tells them apart), headers and usual one-line notices, by SPDX-like name.
TEMPLATES = {
    "AGPL-3.0": [_GPL_NOTICE.format(":", " Affero", ", either", "3"), _GPL_HEAD.format(" AFFERO", "3, 19 November 2007", "2007", " <https://fsf.org/>")],
    "Apache-2.0": [_APACHE_HEADER, _APACHE_HEAD, "Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the Apache License Version 2.0"],
    "BSD-2-Clause": [f"{_BSD_HEAD} {_BSD_TAIL}", "Redistributed under the BSD 2-Clause License"],
    "BSD-3-Clause": [f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}", "Redistributed under the BSD 3-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": [_GPL_NOTICE.format(";", "", "; either", "2"), _GPL_HEAD.format("", "2, June 1991", "1989, 1991", " 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"), "This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": [_GPL_NOTICE.format(":", "", ", either", "3"), _GPL_HEAD.format("", "3, 29 June 2007", "2007", " <https://fsf.org/>"), "This work is licensed under the GNU General Public License, version 3"],
    "ISC": [_ISC_BODY, "Released under the ISC License"],
    "LGPL-2.1": [_GPL_NOTICE.format(";", " Lesser", "; either", "2.1"), _GPL_HEAD.format(" LESSER", "2.1, February 1999", "1991, 1999", " 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"), "This library is licensed under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": [_GPL_HEAD.format(" LESSER", "3, 29 June 2007", "2007", " <https://fsf.org/>")],
    "MIT": [_MIT_BODY, "Released under the MIT License"],
    "MPL-2.0": [_MPL_HEADER, "Mozilla Public License Version 2.0"],
    "Proprietary": ["All rights reserved"],
    "Unlicense": [_UNLICENSE],
    "Zlib": [_ZLIB],
}

#: Files that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
#: A template of twice the tokens wins over one whose cosine is so little better: licences stand beside one-line notices.
NEAR = 0.1
#: Words that the driver, or a task's counts, may hold at once; bits of the filter that stands for more of them.
HELD_WORDS, SKETCH = 200_000, 1 << 24

_TOKEN = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Matcher:
    """TF-IDF vectors of the templates, and the cosines of a text's windows to them.

    ``df``: in how many of ``n`` texts of the corpus a word occurs. Words that
    are neither there nor in a template weigh 1, the least of any word, so that
    no window scores less than with their counts. Only cosines of ``least`` or
    more are sure to be found. A template's windows are all runs of as many
    tokens as it has, over line ends, or the whole of a shorter text.
    """

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, least: float):
        self.least, self.n = least, n
        self.idf = {w: self.weight(df.get(w, 0)) for w in vocabulary(templates) | df.keys()}
        self.vectors, self.names = [], []
        for name, notices in templates.items():
            for notice in notices:
                v = {w: c * self.idf[w] for w, c in Counter(tokens(notice)).items()}
                norm = sqrt(sum(x * x for x in v.values()))
                v = {w: x / norm for w, x in v.items()}
                # the cosine of a window without a template's heavy words is at most the root of what its others weigh
                heavy, light = set(), 0.0
                for w in sorted(v, key=lambda w: (v[w], w)):
                    light += v[w] ** 2
                    if light >= least * least - 1e-9:
                        heavy.add(w)
                self.names.append(name)
                self.vectors.append((len(tokens(notice)), v, heavy))
        self.heavy = set().union(*(h for _, _, h in self.vectors)) if self.vectors else set()
        self.any = re.compile("|".join(map(re.escape, sorted(self.heavy)))) if self.heavy else None

    def weight(self, df: int) -> float:
        """The inverse document frequency of a word that ``df`` texts have."""
        return log((1 + self.n) / (1 + df)) + 1

    def matches(self, words: list[str], whole: bool = True, df: dict[str, int] | None = None) -> Iterator[tuple[int, int, float]]:
        """(template, first token, cosine) of all windows of ``least`` or more; ``whole``: the words are a text, so that it may be shorter than a template; ``df``: counts of words beside those known."""
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.heavy:
                places.setdefault(w, []).append(k)
        if not places:
            return
        idf, n = self.idf, len(words)
        if df:
            idf = {w: self.weight(c) for w, c in df.items()} | idf
        for t, (size, v, heavy) in enumerate(self.vectors):
            if size > n and not whole:
                continue
            hits = sorted(p for w in heavy & places.keys() for p in places[w])
            last, done = max(0, n - size), -1
            for p in hits:
                a, stop = max(0, p - size + 1, done + 1), min(p, last)
                if a > stop:
                    continue
                count = Counter(words[a : a + size])
                dot = sum(c * idf[w] * v[w] for w, c in count.items() if w in v)
                square = sum((c * idf.get(w, 1.0)) ** 2 for w, c in count.items())
                while True:
                    if dot > 0 and dot >= (self.least - 1e-9) * sqrt(max(square, 1e-12)):
                        yield t, a, dot / sqrt(square)
                    if a == stop:
                        break
                    # the next window: one word leaves, one comes
                    for w, change in ((words[a], -1), (words[a + size], 1)):
                        x, c = idf.get(w, 1.0), count[w]
                        square += x * x * ((c + change) ** 2 - c * c)
                        count[w] = c + change
                        if w in v:
                            dot += change * x * v[w]
                    a += 1
                done = stop

    def best(self, found: list[tuple[int, int, float]]) -> tuple[float, int, int]:
        """(cosine, template, first token): of a template its best window, the first of equals; of templates the best cosine (the longer of equals), unless one of twice the length comes within ``NEAR`` of it."""
        own: dict[int, tuple[float, int]] = {}
        for t, a, c in found:
            if t not in own or c > own[t][0] + 1e-9 or abs(c - own[t][0]) <= 1e-9 and a < own[t][1]:
                own[t] = (c, a)
        choice, among = -1, list(own)
        while among:
            choice = max(among, key=lambda t: (round(own[t][0], 9), self.vectors[t][0], -t))
            among = [t for t in own if self.vectors[t][0] >= 2 * self.vectors[choice][0] and own[t][0] >= own[choice][0] - NEAR]
        return (own[choice][0], choice, own[choice][1]) if choice >= 0 else (0.0, -1, -1)

    def candidates(self, text: str) -> list[tuple[bool, list[int], list[str]]]:
        """Stretches of a text that hold all its windows of ``least`` or more: (whether all of it, each token's line, tokens)."""
        low = text.lower()
        if self.any is None or not self.any.search(low):
            return []
        found = list(_TOKEN.finditer(low))
        words = [m.group() for m in found]
        ranges = sorted({(a, min(len(words), a + self.vectors[t][0])) for t, a, _ in self.matches(words)})
        if not ranges:
            return []
        breaks = [m.start() for m in re.finditer("\n", low)]
        merged: list[list[int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(b - a == len(words), [bisect_right(breaks, m.start()) for m in found[a:b]], words[a:b]) for a, b in merged]


def vocabulary(templates: dict[str, list[str]]) -> set[str]:
    return {w for t in templates.values() for notice in t for w in tokens(notice)}


class Listed:
    """A set of words, and which of a text's words it has."""

    def __init__(self, words: set[str]):
        self.words = words

    def pick(self, found: list[str]) -> set[str]:
        return self.words.intersection(found)


class Sketched:
    """A Bloom filter of words: it has all of them and a few others, in a fixed number of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def pick(self, found: list[str]) -> set[str]:
        bits, digest, out = self.bits, xxhash.xxh64_intdigest, set()
        for w in set(found):
            h = digest(w, 42)
            if all(int(bits[(h >> at & SKETCH - 1) >> 6]) >> (h >> at & 63) & 1 for at in (0, 32)):
                out.add(w)
        return out


def sketch(words: DataFrame) -> Sketched:
    """The filter of a column ``word``; what reaches the driver are its ``SKETCH`` bits at most."""
    at = F.explode(F.array(*[F.shiftrightunsigned(F.xxhash64("word"), k).bitwiseAND(F.lit(SKETCH - 1).cast("long")) for k in (0, 32)]))
    cells = words.select(at.alias("at")).distinct().groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    out = np.zeros(SKETCH >> 6, dtype=np.int64)
    for r in cells.collect():
        out[r.cell] = r.bits
    return Sketched(out.view(np.uint64))


def corpus_counts(files: DataFrame, text_col: str, words: Listed | Sketched) -> DataFrame:
    """``word`` and ``n``, in how many texts each of ``words`` occurs; the empty word counts all texts. Counted over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
        count: Counter = Counter()
        for _, texts in text_blocks(batches, "text"):
            count[""] += len(texts)
            for text in texts:
                count.update(words.pick(tokens(text)))
            if len(count) > HELD_WORDS:
                yield rows(count)
                count = Counter()
        yield rows(count)

    return files.select(files[text_col].cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = 0.7) -> DataFrame:
    """``files`` without text, with own and inherited licences.

    All windows of a whole text (headers, licence files, and all between), over
    line ends, are compared with the templates by the cosine of sparse TF-IDF
    vectors, whose document frequencies are counted over all texts. The best
    template of ``least`` or more (see ``Matcher.best``) gives ``own_license``,
    ``own_score`` and ``own_line``, where its window begins (null, 0 and -1
    otherwise). ``license`` is the own one, or else that of the nearest
    directory at or above the file that has a licence file with one;
    ``inherited_from`` names that directory.

    Three passes over the texts: one counts the templates' words; one finds the
    stretches whose windows may reach ``least`` if words outside the templates
    weigh as little as they can, and one counts those words, whose true weights
    only lower a cosine. Their counts are joined to the stretches as a table;
    the driver gets at most ``HELD_WORDS`` of these words, or a filter of a
    fixed number of bits for them. Directories are resolved first, each distinct one
    once, by equi-joins of its ancestors' paths; files join theirs after that.

    Null texts count as empty; a file with a null path inherits nothing; repeated rows
    give a row each; an empty table gives no rows. Columns named like the new
    ones are replaced; a directory with several licence files goes by the best
    score, then the name.
    """
    templates = templates or TEMPLATES
    new = ("own_license", "own_score", "own_line", "license", "inherited_from")
    files = files.drop(*new)
    known = {r.word: r.n for r in corpus_counts(files, text_col, Listed(vocabulary(templates))).collect()}  # the templates' words at most
    n = known.pop("", 0)
    rest = [c for c in files.columns if c != text_col]
    folder, base, near_folder, cands = fresh(files, "qf_dir", "qf_base", "qf_near", "qf_candidates")
    kept = files.select(*[F.col(f"`{c}`") for c in rest])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, kind = Matcher(templates, known, n, least), pa.list_(pa.struct([("whole", pa.bool_()), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))]))
        for rows, texts in text_blocks(batches, text_col):
            got = [[{"whole": a, "lines": b, "words": c} for a, b, c in matcher.candidates(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in rest], pa.array(got, kind)], [*rest, cands])

    stretch = T.StructType([T.StructField("whole", T.BooleanType()), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.StringType()))])
    # written, as all that follows needs no text
    maybe = cut_lineage(files.mapInArrow(find, schema_with(kept, **{cands: T.ArrayType(stretch)})))
    row, counted = fresh(maybe, "qf_row", "qf_counts")
    maybe = maybe.withColumn(row, F.monotonically_increasing_id())
    heard = F.array_distinct(F.flatten(F.transform(cands, lambda c: c["words"])))
    heard = maybe.where(F.size(cands) > 0).select(row, F.explode(heard).alias("word"))
    others = cut_lineage(heard.select("word").distinct())
    words = others.limit(HELD_WORDS + 1).collect()
    asked = Listed({r.word for r in words} - known.keys()) if len(words) <= HELD_WORDS else sketch(others)
    df = cut_lineage(corpus_counts(files, text_col, asked).where("word <> ''"))
    df = cut_lineage(heard.join(df, "word").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias(counted)))
    maybe = maybe.join(df, row, "left").select(*[F.col(f"`{c}`") for c in rest], cands, counted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, known, n, least)
        for rows in batches:
            license_, value, line = [], [], []
            for parts, counts in zip(rows.column(len(rest)).to_pylist(), rows.column(len(rest) + 1).to_pylist(), strict=True):
                found, lines, counts = [], [], dict(counts or [])
                for part in parts:
                    found += [(t, len(lines) + a, c) for t, a, c in matcher.matches(part["words"], part["whole"], counts)]
                    lines += part["lines"]
                best = matcher.best(found)
                ok = best[1] >= 0 and best[0] >= least - 1e-9
                license_.append(matcher.names[best[1]] if ok else None)
                value.append(min(1.0, round(best[0], 9)) if ok else 0.0)
                line.append(lines[best[2]] if ok else -1)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(rest)], pa.array(license_, pa.string()), pa.array(value, pa.float64()), pa.array(line, pa.int64())], [*rest, *new[:3]])

    found = maybe.mapInArrow(score, schema_with(kept, own_license=T.StringType(), own_score=T.DoubleType(), own_line=T.LongType()))
    path = F.col(path_col)
    found = found.withColumn(folder, F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit("")))
    found = found.withColumn(base, F.regexp_extract(path, "([^/]*)$", 1))
    speaks = found.where(F.col(folder).isNotNull() & F.col("own_license").isNotNull() & F.col(base).rlike(LICENCE_FILE))
    # written, as are the folders' licences: a folder of very many files is then one key of two plain shuffles, which can be split
    named = cut_lineage(speaks.groupBy(F.col(folder).alias("above")).agg(F.max_by("own_license", F.struct("own_score", base, "own_license")).alias("license")))
    parts = F.split(folder, "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    folders = found.select(folder).where(F.col(folder).isNotNull()).distinct()
    near = folders.select(folder, F.posexplode(above).alias("depth", "above")).join(named, "above")
    near = cut_lineage(near.groupBy(F.col(folder).alias(near_folder)).agg(F.max_by("license", "depth").alias("license"), F.max_by("above", "depth").alias("inherited_from")))
    out = found.join(near, F.col(folder) == F.col(near_folder), "left")
    own = F.col("own_license")
    return out.select(*[F.col(f"`{c}`") for c in rest], *new[:3], F.coalesce(own, F.col("license")).alias("license"), F.when(own.isNull(), F.col("inherited_from")).alias("inherited_from"))
