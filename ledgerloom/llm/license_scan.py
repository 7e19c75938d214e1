"""License scans as an exact set-similarity join of text blocks with license notices.

A notice's set is its distinct words. A block is any run of words 1.25 times as long as the notice
(the whole text, where that is shorter). The join finds every block that holds at least the
threshold's share of the notice's set. Words of notices are put in order of their frequency over
all texts, rarest first; of a set of n words of which m must be met, a block without any of the
first n - m + 1 cannot qualify (prefix filter), nor one of fewer than m words (length filter), nor
one in a stretch of text that, along the order, has missed more than n - m words (positional
filter). Only blocks around prefix words are looked at, stretch by stretch, and what passes is
verified on full sets. Qualifying blocks that start at neighbouring words are one match, from the
first word of the first to the last word of the last; every qualifying block lies in a match.

Notices of different licenses may share nearly all their words. Sisters are notices of other labels whose whole text
would meet the threshold. A block that qualifies is a notice's own, and names its license, if it holds all
words that set the notice apart from each sister; where none do (its words are part of the sister's),
it must lack one of those that set the sister apart. Matches tell which are their notice's own; only those give labels.

Beside the join, fixed phrases are counted word for word (base places).

Defined cases: null and wordless texts have no words, no labels and score 0; repeated rows give
repeated rows; a null doc_id stays null; a text of any length is scanned whole, in time that
grows with its words; blocks of several notices may overlap and all count; an empty table gives an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, ship

THRESHOLD = 0.9
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Public license notices: fixed values.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
]
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of digits, a-z and letters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORD).split()


class Notice:
    def __init__(self, label: str, text: str, frequency: dict[bytes, int], threshold: float):
        words = words_of(text)
        self.label = label
        self.order = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        self.need = math.ceil(threshold * len(self.order) - 1e-9)
        self.prefix = self.order[: len(self.order) - self.need + 1]
        self.length = math.ceil(1.25 * len(words))
        self.required: set[bytes] = set()
        self.forbidden: list[set[bytes]] = []

    def set_apart(self, others: list[Notice]) -> None:
        """Learns which words tell the notice from its sisters among others."""
        own = set(self.order)
        for other in others:
            if other.label != self.label and len(own.intersection(other.order)) >= self.need:
                self.required |= own.difference(other.order)
                if own.issubset(other.order) and len(other.order) > len(own):
                    self.forbidden.append(set(other.order) - own)

    def is_own(self, places: dict[bytes, list[int]], first: int, last: int) -> bool:
        """Whether one of the qualifying blocks from word first to word last is the notice's own."""
        if not self.required and not self.forbidden:
            return True
        length, apart = min(self.length, last - first + 1), set().union(*self.forbidden)
        here = sorted((p, w) for w in [*self.order, *apart] for at in [places.get(w, ())] for p in at[bisect_left(at, first) : bisect_left(at, last + 1)])
        left, right, inside = 0, 0, Counter()
        for s in range(first, last - length + 2):
            while right < len(here) and here[right][0] < s + length:
                inside[here[right][1]] += 1
                right += 1
            while left < right and here[left][0] < s:
                inside[here[left][1]] -= 1
                if not inside[here[left][1]]:
                    del inside[here[left][1]]
                left += 1
            met = inside.keys()
            if self.required <= met and not any(f <= met for f in self.forbidden) and sum(w in inside for w in self.order) >= self.need:
                return True
        return False

    def _may_hold(self, places: dict[bytes, list[int]], first: int, last: int) -> bool:
        """Whether words first to last hold enough of the set; gives up at the first miss too many, rarest words first."""
        left = len(self.order) - self.need
        for w in self.order:
            at = places.get(w, ())
            i = bisect_left(at, first)
            if i == len(at) or at[i] > last:
                left -= 1
                if left < 0:
                    return False
        return True

    def matches(self, places: dict[bytes, list[int]], n: int) -> list[tuple[int, int, int]]:
        """All qualifying blocks, those with neighbouring starts as one: (most words met by one of them, first, last)."""
        if n < self.need or not any(w in places for w in self.prefix):
            return []
        # blocks that hold a prefix word, as stretches of starts
        length = min(self.length, n)
        at = sorted({p for w in self.prefix for p in places.get(w, ())})
        starts: list[list[int]] = []
        for p in at:
            a, b = max(0, p - length + 1), min(p, n - length)
            if starts and a <= starts[-1][1] + 1:
                starts[-1][1] = b
            else:
                starts.append([a, b])
        starts = [[a, b] for a, b in starts if self._may_hold(places, a, b + length - 1)]
        if not starts:
            return []
        here = sorted((p, w) for w in self.order for p in places.get(w, ()))
        found: list[tuple[int, int, int]] = []
        left, right, inside = 0, 0, Counter()
        for a, b in starts:
            for s in range(a, b + 1):
                while right < len(here) and here[right][0] < s + length:
                    inside[here[right][1]] += 1
                    right += 1
                while left < right and here[left][0] < s:
                    inside[here[left][1]] -= 1
                    if not inside[here[left][1]]:
                        del inside[here[left][1]]
                    left += 1
                if len(inside) >= self.need:
                    if found and found[-1][2] == s + length - 2:
                        found[-1] = (max(found[-1][0], len(inside)), found[-1][1], s + length - 1)
                    else:
                        found.append((len(inside), s, s + length - 1))
        return found


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the notices stands in all texts; as many rows as the notices have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(filter(vocabulary.__contains__, words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


def base_places(words: list[bytes]) -> list[tuple[str, int]]:
    """Label and first word of every place where a base phrase stands; words are counted on from place to place."""
    line, out = b" " + b" ".join(words) + b" ", []
    for label, phrase in BASE:
        sought, from_, word = f" {phrase} ".encode(), 0, 0
        at = line.find(sought)
        while at >= 0:
            word, from_ = word + line.count(b" ", from_, at), at
            out.append((label, word))
            at = line.find(sought, at + 1)
    return out


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    ship(docs.sparkSession)
    vocabulary = {w for _, text in notices for w in words_of(text)}
    frequency = frequencies(docs, vocabulary)
    templates = [Notice(label, text, frequency, threshold) for label, text in notices]
    by_prefix: dict[bytes, list[int]] = {}  # from a prefix word to the notices that it may open
    for i, t in enumerate(templates):
        t.set_apart(templates)
        for w in t.prefix:
            by_prefix.setdefault(w, []).append(i)
    match = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64()), ("own", pa.bool_())])

    def scan(text: str | None) -> tuple:
        words = words_of(text)
        base = base_places(words)
        found = []
        if not by_prefix.keys().isdisjoint(words):
            places: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in vocabulary:
                    places.setdefault(w, []).append(i)
            for t in (templates[i] for i in sorted({i for w in places for i in by_prefix.get(w, ())})):
                for met, first, last in t.matches(places, len(words)):
                    found.append({"label": t.label, "first": first, "last": last, "share": met / len(t.order), "own": t.is_own(places, first, last)})
        at = [p for _, p in base]
        labels = {x for x, _ in base}
        score = max([1.0 if base else 0.0, *(m["share"] for m in found)])
        return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m["label"] for m in found if m["own"]})), score, found

    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(match))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(text) for text in batch.column(1).to_pylist()]
            columns = {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | columns)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, first: long, last: long, share: double, own: boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("matches")
