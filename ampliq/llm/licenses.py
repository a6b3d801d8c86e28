"""Licence scan: passages against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_or_empty

WORD = re.compile(r"\w+")
#: Wording of public licences and of the notices that grant them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
           "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
           "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
           "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
           "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
           "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
           "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
           "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                  "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
               "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
               "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Word pairs of the normalised text: lower case, words only."""
    words = WORD.findall(text.lower())
    return frozenset(zip(words, words[1:]))


class Templates:
    """Templates ordered by size, so that the sizes a Dice bound allows are one stretch."""

    def __init__(self, templates: dict[str, str], least: float):
        self.all = sorted(((len(b), name, b) for name, t in templates.items() if (b := bigrams(t))), key=lambda x: x[:2])
        self.pairs = frozenset(p for _, _, b in self.all for p in b)
        self.least = least
        self.largest = max((n for n, _, _ in self.all), default=0) * (2 - least) / least

    def best(self, found: frozenset | set) -> tuple[str, float] | None:
        """The most similar template at or above the bound (ties to the name that sorts first). A template of size b can
        reach it only if 2 min(a, b) >= bound * (a + b); others are pruned unseen."""
        size, out = len(found), None
        for b, name, pairs in self.all:
            if 2 * min(size, b) < self.least * (size + b):
                continue
            score = 2 * len(found & pairs) / (size + b)
            if score >= self.least and (out is None or (-score, name) < (-out[1], out[0])):
                out = (name, score)
        return out

    def windows(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, licence, score) of the best stretches of words for each template, whatever the lines; of
        stretches that overlap, the one that shares more pairs stays, then the more similar one.

        A best stretch begins and ends with a pair of its template, and its first pair doesn't come again in it. Templates
        of whose pairs a text has too few for the bound are pruned.
        """
        pairs = list(zip(words, words[1:]))
        have, found = self.pairs.intersection(pairs), []
        if not have:
            return []
        for size, name, template in self.all:
            least = size * self.least / (2 - self.least) - 1e-9
            if len(have) < least or len(template & have) < least:
                continue
            most = size * (2 - self.least) / self.least + 1e-9
            for i, first in enumerate(pairs):
                if first not in template:
                    continue
                seen, shared = {first}, 1
                best = (2 / (1 + size), i)
                for j in range(i + 1, len(pairs)):
                    pair = pairs[j]
                    if pair in seen:
                        if pair == first:
                            break
                        continue
                    seen.add(pair)
                    if len(seen) > most:
                        break
                    if pair in template:
                        shared += 1
                        score = 2 * shared / (len(seen) + size)
                        if score > best[0]:
                            best = (score, j)
                        if shared == size:
                            break
                if best[0] >= self.least:
                    found.append((-round(best[0] * size), -best[0], name, i, best[1] + 1))
        taken, out = [], []
        for _, score, name, a, b in sorted(found):
            k = bisect(taken, (a, b))
            if (k and taken[k - 1][1] >= a) or (k < len(taken) and taken[k][0] <= b):
                continue
            taken.insert(k, (a, b))
            out.append((a, b, name, -score))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, last line, licence, score) of a text's passages: single lines, runs of neighbouring lines at least
        half of whose pairs are template pairs, the whole text, and stretches of words where no such passage has the licence."""
        lines = [WORD.findall(line) for line in text.lower().split("\n")]
        out, run, filled = {}, [], 0
        whole: set | None = set()
        before = None

        def look(first: int, last: int, pairs: set) -> None:
            hit = self.best(pairs)
            if hit:
                out[first, last] = hit

        def end_run() -> None:
            if len(run) > 1:
                words = [w for ws in lines[run[0]:run[-1] + 1] for w in ws]
                look(run[0], run[-1], set(zip(words, words[1:])))
            run.clear()

        for i, words in enumerate(lines):
            if not words:
                continue
            filled += 1
            pairs = set(zip(words, words[1:]))
            hits = 0 if self.pairs.isdisjoint(pairs) else len(self.pairs & pairs)
            if hits:
                look(i, i, pairs)
            if 2 * hits >= len(pairs):
                run.append(i)
            else:
                end_run()
            if whole is not None:  # a text that has outgrown the largest template's bound is pruned
                whole |= pairs
                if before is not None:
                    whole.add((before, words[0]))
                before = words[-1]
                whole = whole if len(whole) <= self.largest else None
        end_run()
        if whole and filled > 1:
            look(0, len(lines) - 1, whole)
        rows = [(a, b, *hit) for (a, b), hit in out.items()]
        line = [i for i, words in enumerate(lines) for _ in words]
        for a, b, name, score in self.windows([w for words in lines for w in words]):
            if not any(hit[0] == name and first <= line[b] and last >= line[a] for (first, last), hit in out.items()):
                rows.append((line[a], line[b], name, score))
        return sorted(rows)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_line, last_line (from 0), license, dice of every passage whose best template reaches ``least``.

    Passages are the lines, runs of neighbouring lines made of template pairs, the whole text, and stretches of words inside
    of lines or runs, given by the lines they begin and end in. Null and empty texts, and texts of one word, give no
    row; repeated rows each give theirs. The templates are a parameter of bounded size that travels with the code. No shuffle.
    """
    short_batches(docs.sparkSession)
    table = Templates(TEMPLATES if templates is None else templates, least)

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in table.scan(t)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)],
                                             names=["doc_id", "first_line", "last_line", "license", "dice"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, first_line int, last_line int, license string, dice double")
