"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest directory.

Runs of lines around a word of enough weight are a file's candidate statements:
every run that begins and ends with a line with words of templates and has no
more words than could still reach the threshold with the longest template. Their
sparse TF-IDF vectors are compared with the templates' by cosine; a statement
below the threshold isn't one. Versions and the words that tell licences of a
family apart (``TELLING``) must be the template's. Words that can be skipped are found from the
weights: lines with none of the trigger words cannot reach the threshold, nor can
templates of which a text has too few words at all, so nothing is lost. Of equal runs the first and shortest counts. A file named like a licence file speaks for its directory; a file without a
statement of its own takes the licence of its nearest ancestor directory.
Directories, not files, are joined with their ancestors, so the join grows with
the directories and their depth.

Null and empty texts have no statement, but inherit. Very long texts are scanned
whole. An empty table gives an empty one. A null path inherits nothing. Ties go to the first template by name; of a directory's licence files
the one with the highest cosine counts, then the least path. Repeated rows stay
rows. Extra columns stay, those named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize

THRESHOLD = 0.6
LICENSE_FILE = r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(^|/)copying[^/]*$|(^|/)notice[^/]*$"

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def _gnu(title: str, number: str, date: str, *more: str) -> list[str]:
    """A GNU licence's title, its notice and a plain statement."""
    return [f"GNU {title} Version {number}, {date}", f"This work is licensed under the GNU {title}, version {number}.", _GNU.format(title, number), *more]


def _documentation(number: str, date: str) -> list[str]:
    return [f"GNU Free Documentation License Version {number}, {date}", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {number} or any later version published by the Free Software Foundation"]


def _commons(short: str, title: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {title} 4.0 International License.", f"Creative Commons {title} 4.0 International Public License"]


# Titles, customary notices and, where they are short, full texts of public licences, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "19 November 2007"),
    "Apache-1.1": ["The Apache Software License, Version 1.1"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "Artistic-1.0": ['The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package'],
    "Artistic-2.0": ["The Artistic License 2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the simplified BSD license.", f"{_BSD} {_BSD_WARRANTY}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"],
    "BSD-4-Clause": [f"{_BSD} {_ADVERTISING} {_BSD_NAMES} {_BSD_WARRANTY}"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": _commons("BY", "Attribution"),
    "CC-BY-NC-4.0": _commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _commons("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License (CDDL) Version 1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0."],
    "EPL-1.0": ["Eclipse Public License - v 1.0", "made available under the terms of the Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "made available under the terms of the Eclipse Public License 2.0"],
    "GFDL-1.1": _documentation("1.1", "March 2000"),
    "GFDL-1.2": _documentation("1.2", "November 2002"),
    "GFDL-1.3": _documentation("1.3", "3 November 2008"),
    "GPL-1.0": _gnu("General Public License", "1", "February 1989"),
    "GPL-2.0": _gnu("General Public License", "2", "June 1991", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007"),
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "LGPL-2.0": _gnu("Library General Public License", "2", "June 1991"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "29 June 2007"),
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}

#: Words that make another licence of a family's name: a statement has those of its template, no others.
TELLING = frozenset("affero lesser library documentation noncommercial nc sharealike sa noderivatives nd".split())
#: Longer templates are texts, in which numbers and telling words are ordinary.
NOTICE_WORDS = 45

#: Words of any English text, which have no weight.
FUNCTION_WORDS = frozenset("a all an and any as at be by can either except for found free from has have in into is it its later may not of on one or possible subject that the this to under use v via was with without work you your".split())

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_DIGITS = frozenset("0123456789")
_VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def tokens(text: str) -> list[str]:
    """Words that have weight; version numbers without a v before and a .0 behind."""
    return [(m[1] if (m := _VERSION.fullmatch(w)) else w) for w in _WORD.findall(text.lower()) if w not in FUNCTION_WORDS]


def required(name: str, words: Counter[str]) -> tuple[frozenset[str], frozenset[str] | None]:
    """What a statement must have to be taken for a template: the version in the licence's name, where the template has it, and, for a notice, its telling words and no others."""
    if sum(words.values()) > NOTICE_WORDS:
        return frozenset(), None
    versions = {w for part in name.split("-") for w in tokens(part) if w[0].isdigit()}
    return frozenset(versions & words.keys()), frozenset(TELLING & words.keys())


class Matcher:
    """Templates as sparse unit vectors with an inverted index, and the trigger words."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        entries = [(name, Counter(tokens(t))) for name in sorted(templates) for t in templates[name]]
        n, df = len(entries), Counter(w for _, c in entries for w in c)
        self.names, self.threshold = [name for name, _ in entries], threshold
        self.required = [required(name, c) for name, c in entries]
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.unseen = math.log(1 + n) + 1
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.triggers_of: list[set[str]] = [set() for _ in entries]
        for i, (_, counts) in enumerate(entries):
            vector = {w: c * self.idf[w] for w, c in counts.items()}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            for w, x in sorted(vector.items()):
                self.index[w].append((i, x / norm))
            # Words are passed over, numbers, short and light ones first, while a line of passed words alone stays below the threshold.
            passed = 0.0
            for w, x in sorted(vector.items(), key=lambda e: (not e[0][0].isdigit(), len(e[0]) > 3, e[1], e[0])):
                passed += (x / norm) ** 2
                if passed >= (threshold - 1e-9) ** 2:
                    self.triggers_of[i].add(w)
        self.triggers = frozenset().union(*self.triggers_of)
        #: Words of a run: all of the longest template's and as many others of equal weight as leave the threshold in reach.
        self.most_words = math.ceil(max((sum(c.values()) for _, c in entries), default=0) / threshold**2)

    def present(self, lower: str) -> set[str]:
        """The triggers in a text of templates that can be in it: with all words that they require and, by the words that it shares, the threshold in reach."""
        raw = set(_WORD.findall(lower))
        words = self.idf.keys() & raw
        words |= {t for w in raw if w[-1] in _DIGITS for t in tokens(w) if t in self.idf}
        if self.triggers.isdisjoint(words):
            return set()
        reach: dict[int, float] = defaultdict(float)
        for w in words:
            for i, y in self.index[w]:
                reach[i] += y * y
        least = (self.threshold - 1e-9) ** 2
        return {t for i, x in reach.items() if x >= least and self.required[i][0] <= words and (self.required[i][1] or frozenset()) <= words for t in self.triggers_of[i] & words}

    def best(self, statement: str) -> tuple[str | None, float]:
        """The closest template's name and cosine; no name below the threshold."""
        counts = Counter(tokens(statement))
        dots: dict[int, float] = defaultdict(float)
        square = 0.0
        for w, c in counts.items():
            x = c * self.idf.get(w, self.unseen)
            square += x * x
            for i, y in self.index.get(w, ()):
                dots[i] += x * y
        telling = TELLING & counts.keys()
        dots = {i: x for i, x in dots.items() if self.required[i][0] <= counts.keys() and self.required[i][1] in (None, telling)}
        if not dots:
            return None, 0.0
        norm = math.sqrt(square)
        i = min(dots, key=lambda i: (-round(dots[i] / norm, 12), i))
        cosine = round(dots[i] / norm, 12)
        return (self.names[i], cosine) if cosine >= self.threshold else (None, cosine)

    def scan(self, text: str | None) -> tuple[str | None, float, int | None]:
        """A file's best statement: licence, cosine, number of its first line."""
        best: tuple[str | None, float, int | None] = (None, 0.0, None)
        if not text:
            return best
        lower = text.lower()
        present = self.present(lower)
        if not present:
            return best
        starts = [0, *(m.end() for m in re.finditer("\n", lower))]
        numbers = set()
        for t in present:
            at = lower.find(t)
            while at >= 0:
                k = bisect_right(starts, at)
                numbers.add(k - 1)
                at = lower.find(t, starts[k]) if k < len(starts) else -1  # from the next line on
        ends = [*(a - 1 for a in starts[1:]), len(lower)]
        words: dict[int, list[str]] = {}

        def line(n: int) -> list[str]:
            if n not in words:
                words[n] = tokens(lower[starts[n] : ends[n]])
            return words[n]

        stated = [n for n in sorted(numbers) if not self.triggers.isdisjoint(line(n))]
        before = -1
        for at in stated:
            first, room = at, self.most_words - len(line(at))
            while first - 1 > before and room >= len(line(first - 1)):
                first -= 1
                room -= len(line(first))
            for start in range(first, at + 1):
                best = self._runs_from(start, at, len(starts), line, best)
                if best[1] >= 1:  # no other can be closer
                    return best
            before = at
        return best

    def _runs_from(self, start: int, trigger: int, n_lines: int, line: Callable[[int], list[str]], best: tuple[str | None, float, int | None]) -> tuple[str | None, float, int | None]:
        """The better of ``best`` and the runs of lines from ``start`` on that reach the line ``trigger``."""
        if self.idf.keys().isdisjoint(line(start)):
            return best
        counts: Counter[str] = Counter()
        dots, square, n = [0.0] * len(self.names), 0.0, 0
        for end in range(start, n_lines):
            n += len(line(end))
            if n > self.most_words and end > start:
                break
            known = False
            for w in line(end):
                x = self.idf.get(w, self.unseen)
                square += (2 * counts[w] + 1) * x * x
                counts[w] += 1
                for i, y in self.index.get(w, ()):
                    dots[i] += x * y
                    known = True
            # Sums taken in another order differ in the last digits: what may be better is computed again.
            if known and end >= trigger and max(dots) >= (max(best[1], self.threshold) - 1e-9) * math.sqrt(square):
                name, cosine = self.best(" ".join(counts.elements()))
                if name and cosine > best[1]:
                    best = (name, cosine, start)
        return best


_OWN = [T.StructField("own_license", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("line", T.IntegerType())]
_ADDED = ("own_license", "cosine", "line", "license", "origin", "license_path")


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top, null for the top itself."""
    cut = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(path != "", cut)


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, is_license_file: Column | None = None, keep_text: bool = True) -> DataFrame:
    """``files`` (path, text) with license, cosine, line, origin (own, inherited or none) and license_path, the file that states it."""

    def make():
        matcher = Matcher(templates, threshold)

        def run(batch: pa.RecordBatch) -> dict:
            found = [matcher.scan(t) for t in batch.column("text").to_pylist()]
            return {n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate((("own_license", pa.string()), ("cosine", pa.float64()), ("line", pa.int32())))}

        return run

    columns = [c for c in files.columns if c.lower() not in _ADDED]
    others = [F.col(f"`{c}`") for c in columns if c != "text"]  # in a struct, where no name can clash
    speaks = is_license_file if is_license_file is not None else F.col("path").rlike(LICENSE_FILE)
    rows = files.select(F.struct(*others).alias("row"), "path", "text", speaks.alias("speaks"), parent(F.col("path")).alias("__dir"))
    scanned = map_texts(rows, "text", _OWN, make)
    # Written once, as three branches read it.
    scanned = materialize(scanned if keep_text else scanned.drop("text"), "licenses")
    stated = scanned.where(F.col("speaks") & F.col("own_license").isNotNull() & F.col("path").isNotNull())
    order = F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("p"), F.col("own_license").alias("l"))
    said = stated.groupBy("__dir").agg(F.min(order).alias("said")).select(F.col("__dir").alias("at"), F.col("said.p").alias("said_path"), F.col("said.l").alias("said_license"))
    # A directory and its ancestors: a/b/c gives a/b/c, a/b, a and the top.
    folders = scanned.where(F.col("__dir").isNotNull()).select(F.col("__dir").alias("folder")).distinct()
    parts = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(parts))
    chain = folders.select("folder", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn("ancestor", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("depth")), "/"))
    near = chain.join(said, F.col("ancestor") == F.col("at")).groupBy("folder").agg(F.max(F.struct("depth", "said_path", "said_license")).alias("near"))
    joined = scanned.join(near, F.col("__dir") == F.col("folder"), "left")
    own = F.col("own_license").isNotNull()
    return joined.select(
        *((F.col("text") if c == "text" else F.col(f"row.`{c}`")) for c in columns if keep_text or c != "text"),
        F.coalesce("own_license", "near.said_license").alias("license"), F.when(own, F.col("cosine")).alias("cosine"), F.when(own, F.col("line")).alias("line"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(own, F.col("path")).otherwise(F.col("near.said_path")).alias("license_path"),
    )
