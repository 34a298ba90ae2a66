"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Units of a text are its lines; of a long line, windows of words. Besides, whatever the lines, a window of as many words as
a template has, and up to twice as many, starts at every word of the template (a shorter rest of the text is filled up
from before), so words around a notice and line breaks within don't hide it. A unit is compared with every template, a window with its own, by the cosine
of TF-IDF vectors (idf over the templates; common English words weigh nothing). Only units with an anchor word are scored, which loses nothing: a
template's anchors are its heaviest words, as many as it takes for the rest of its vector to stay below the threshold,
so a unit without any of them can't reach it. Nor can a window whose words have less than threshold**2 of the template's
squared weights. Of hits that share words the best counts, templates without a version last. A file's own licence is
its best hit's template.

A licence file (LICENSE, LICENCE, COPYING, NOTICE, with any extension) gives its licence to its directory; a file
without one of its own inherits from its nearest ancestor directory, found by joins on directory paths.

Null texts and paths have no licence and inherit nothing. Ties between templates go to the one first by name, between
licence files of a directory to the higher score, then the licence first by name. Repeated rows are judged each.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
LICENCE_FILE = "(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
WINDOW = 32
#: Words without weight.
COMMON = frozenset("a an and any are by for in is it of on or that the this to under use with without".split())

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_GNU = """This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by
the Free Software Foundation; either version {} of the License, or (at your option) any later version."""
_GNU_CORE = "under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License"
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _spdx(*names: str) -> list[str]:
    return [f"SPDX-License-Identifier: {n}" for n in names]


#: Licences named without a version; any other hit goes first, and they don't count beside one with a version.
GENERIC = {"GPL": {"GPL-2.0", "GPL-3.0"}, "LGPL": {"LGPL-3.0"}}
#: Short forms by which licences are named in headers and licence files, whole headers and openings of licence texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", *_spdx("Apache-2.0"), _APACHE, "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", *_spdx("MIT"),
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", _MIT],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_spdx("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
                _GNU.format("program", "", 3), _GNU_CORE.format("", 3), "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_spdx("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
                _GNU.format("program", "", 2), _GNU_CORE.format("", 2), "GNU General Public License Version 2, June 1991"],
    "GPL": ["under the terms of the GNU General Public License as published by"],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", *_spdx("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
                 _GNU.format("library", "Lesser ", 3), _GNU_CORE.format("Lesser ", 3), "GNU Lesser General Public License Version 3, 29 June 2007"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
                     "Licensed under the BSD 3-Clause License.", *_spdx("BSD-3-Clause"), _BSD],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", *_spdx("MPL-2.0"), _MPL],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", *_spdx("CC-BY-4.0"), "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", *_spdx("CC-BY-NC-4.0"), "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", *_spdx("CC-BY-SA-4.0"), "Creative Commons Attribution-ShareAlike 4.0 International License"],
}


def _named(words: set[str]) -> bool:
    """Whether these words of a template can name it: more than a single word that other texts have too, as German `mit`."""
    return len(words) > 1 or not all(w.isalpha() for w in words)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        texts = [(k, [w for w in WORD.findall(t.lower()) if w not in COMMON]) for k in sorted(templates) for t in templates[k]]
        df = Counter(w for _, ws in texts for w in set(ws))
        self.idf = {w: math.log(1 + len(texts) / n) for w, n in df.items()}
        self.other = math.log(1 + len(texts))  # of a word that no template has
        self.threshold, self.templates, self.counts = threshold, [], []
        self.versions: list[set[str] | None] = []  # forms of the version without which a text of the template has the versionless name
        anchors: set[str] = set()
        for name, ws in texts:
            v = {w: n * self.idf[w] for w, n in Counter(ws).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.templates.append((name, v))
            self.counts.append(Counter(ws))
            n = next((w for w in ws if w in ("2", "3")), None) if any(name in g for g in GENERIC.values()) else None
            self.versions.append({n, f"{n}.0", f"v{n}", f"v{n}.0"} if n else None)
            rest, heavy = 1.0, sorted(v, key=lambda w: (len(w) < 3, -v[w], w))
            for w in heavy:
                if math.sqrt(max(rest, 0)) < threshold - 1e-9:
                    break
                anchors.add(w)
                rest -= v[w] * v[w]
        self.anchors = frozenset(anchors)
        any_of = "|".join(sorted(map(re.escape, anchors), key=lambda a: (-len(a), a))) or "(?!)"
        self.found = re.compile(f"(?<![a-z0-9])(?:{any_of})(?![a-z0-9])")

    def cosine(self, words: list[str]) -> tuple[float, str] | None:
        """The best (score, licence) at or above the threshold of one unit."""
        v = {w: n * self.idf.get(w, self.other) for w, n in Counter(words).items() if w not in COMMON}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        best = None
        for (name, t), version in zip(self.templates, self.versions, strict=True):
            s = sum(x * v[w] for w, x in t.items() if w in v) / norm
            if s >= self.threshold and (version is None or not version.isdisjoint(v)) and (len(v) == 1 or _named(t.keys() & v)) and (best is None or s > best[0]):
                best = (s, name)
        return best

    def units(self, text: str) -> Iterator[tuple[int, int, list[str]]]:
        """(first character, past last, words) of units that hold an anchor; a long line gives windows that overlap by half."""
        low, seen = text.lower(), -1
        for m in self.found.finditer(low):
            if m.start() < seen:
                continue
            a, b = low.rfind("\n", 0, m.start()) + 1, low.find("\n", m.start())
            seen = b if b >= 0 else len(low)
            at = list(WORD.finditer(low, a, seen))
            words = [w.group() for w in at]
            if len(words) <= WINDOW:
                if self.anchors.intersection(words):
                    yield at[0].start(), at[-1].end(), words
            else:
                for i in range(0, len(words) - WINDOW // 2, WINDOW // 2):
                    if self.anchors.intersection(part := words[i : i + WINDOW]):
                        yield at[i].start(), at[i + len(part) - 1].end(), part

    def windows(self, text: str) -> Iterator[tuple[float, str, int, int]]:
        """(score, licence, first character, past last) of a template's best window from each of its words on."""
        low = text.lower()
        there = self.idf.keys() & set(WORD.findall(low))
        need = self.threshold**2 - 1e-9
        near = [k for k, (_, t) in enumerate(self.templates) if sum(t[w] ** 2 for w in t.keys() & there) >= need]
        if not near:
            return
        at = [m for m in WORD.finditer(low) if m.group() not in COMMON]
        words = [m.group() for m in at]
        known = [(i, w) for i, w in enumerate(words) if w in there]
        for k in near:
            (name, t), n, version = self.templates[k], self.counts[k].total(), self.versions[k]
            if version is not None and version.isdisjoint(words):
                continue
            mine = [(i, w) for i, w in known if w in t]
            held, mass, end = Counter(), 0.0, 0
            for i, w in mine:
                while end < len(mine) and mine[end][0] < i + 2 * n:
                    x = mine[end][1]
                    mass += 0 if held[x] else t[x] ** 2
                    held[x] += 1
                    end += 1
                if mass >= need:
                    start = max(0, min(i, len(words) - n))
                    s, last = self._best(words, start, k)
                    if s >= self.threshold:
                        yield s, name, at[start].start(), at[last].end()
                held[w] -= 1
                mass -= 0 if held[w] else t[w] ** 2

    def _best(self, words: list[str], start: int, k: int) -> tuple[float, int]:
        """The best (cosine with template k, last word) of the windows of n to 2 * n words from start on that have the version, or of what there is.

        A word that is repeated counts as often as the template has it for the match, as often as it occurs for the length.
        """
        count: Counter[str] = Counter()
        t, most, version = self.templates[k][1], self.counts[k], self.versions[k]
        n = most.total()
        met: set[str] = set()
        dot = square = 0.0
        best, last, dated, named = 0.0, start, version is None, False
        for j in range(start, min(len(words), start + 2 * n)):
            w = words[j]
            x = self.idf.get(w, self.other)
            square += (2 * count[w] + 1) * x * x
            count[w] += 1
            if w in t and count[w] <= most[w]:
                met.add(w)
                named = named or _named(met)
                dot += t[w] * x
            dated = dated or w in version
            if named and dated and (j - start + 1 >= n or j == len(words) - 1) and dot > best * math.sqrt(square) * (1 + 1e-12):
                best, last = dot / math.sqrt(square), j
        return best, last

    def scan(self, text: str) -> tuple[str | None, float, list[str]]:
        hits = [(*h, a, b) for a, b, u in self.units(text) if (h := self.cosine(u))] + list(self.windows(text))
        if not hits:
            return None, 0.0, []
        hits.sort(key=lambda h: (h[1] in GENERIC, -h[0], h[1], h[2]))
        starts, ends, names = [], [], set()  # of hits that count, in order; they don't overlap
        for _, name, a, b in hits:
            k = bisect.bisect_right(starts, a)
            if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
                starts.insert(k, a)
                ends.insert(k, b)
                names.add(name)
        return hits[0][1], hits[0][0], sorted(n for n in names if not GENERIC.get(n, set()) & names)


def license_scan(files: DataFrame, path: F.Column, id_col: str = "doc_id", text_col: str = "text", *,
                 templates: dict[str, list[str]] | None = None, threshold: float = 0.6) -> DataFrame:
    """(id, path, own_license, own_score, licenses, license, inherited_from) of every file.

    `license` is the file's own or the inherited one; `inherited_from` is the directory it comes from.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold)
    kind = files.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scanner.scan(t.as_py() or "") for t in b.column(2)]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.string()))],
                                             names=["id", "path", "own_license", "own_score", "licenses"])

    own = files.select(files[id_col].alias("id"), path.alias("path"), files[text_col].alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, path string, own_license string, own_score double, licenses array<string>")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    own = Workspace(files.sparkSession, "licences").stage(own.withColumn("dir", folder))  # read three times
    best = F.min(F.struct((-F.col("own_score")).alias("s"), "own_license"))
    given = own.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(F.col("dir").alias("up")).agg(best.alias("g"))
    dirs = own.where(F.col("own_license").isNull()).select("dir").dropna().distinct()
    depth = F.size(F.split("dir", "/"))
    ups = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/")))).alias("up")).distinct()
    near = ups.join(given, "up").groupBy("dir").agg(F.max_by(F.struct("up", "g.own_license"), F.length("up")).alias("n"))
    out = own.join(near, "dir", "left")
    mine = F.col("own_license").isNotNull()
    return out.select(F.col("id").alias(id_col), "path", "own_license", "own_score", "licenses",
                      F.when(mine, F.col("own_license")).otherwise(F.col("n.own_license")).alias("license"),
                      F.when(~mine, F.col("n.up")).alias("inherited_from"))


def document_path(doc_id: str = "doc_id", source: str = "source") -> F.Column:
    """A repository-like path for a document: `source/package/module/file`; each module has a licence file."""
    i = F.coalesce(F.col(doc_id), F.lit(0))
    name = F.when(F.pmod(i, F.lit(50)) == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), i, F.lit(".txt")))
    module = F.when(F.pmod(i, F.lit(7)) == 0, F.lit("core")).otherwise(F.lit("core/sub"))
    return F.concat_ws("/", F.coalesce(F.col(source), F.lit("unknown")), F.concat(F.lit("p"), F.floor(i / 200)), module, name)
