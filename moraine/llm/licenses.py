"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

A block is any run of words as long as a template is when only ``threshold`` of it are template words,
so wrapped lines and words put in or left out don't matter. It matches when it holds at least
``threshold`` of the template's distinct words, and its naming words, if it has some. The words of
all templates are ordered by how many documents hold them, counted over the whole table; other words
count as rarer than these. Of a template with n words that needs o in common,

* a matching block holds one of the n - o + 1 rarest (prefix filter), so only the words around those are looked at;
* a text has o words at least (length filter);
* with the first common word at place p of the template and q words behind it in the order among the block's,
  1 + min(n - p - 1, q) must reach o (positional filter).

What passes is verified by sliding over its words. Nothing that meets the threshold is missed.
Blocks that overlap are given as one, with the best containment of them.

The templates are a parameter of fixed size, so they and the frequencies of *their* words are
all that leaves the table; documents are scanned where they are, without a shuffle.

Nulls, ties and odd inputs: a null text is empty, with score 0 and empty labels; rows are
independent; an empty table gives an empty result. Columns other than ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence texts and notices, and the words by which short notices name their licence.
TEMPLATES = {
    "apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
        "apache",
    ),
    "bsd-3-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "",
    ),
    "bsd-notice": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "cc by nc"),
    "gpl-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        "gnu",
    ),
    "gpl-notice": ("This work is licensed under the GNU General Public License, version 3", "gnu general public"),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "",
    ),
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "",
    ),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission"),
    "mit-notice": ("Released under the MIT License", "mit license"),
    "unlicense": (
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "unencumbered",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
        "",
    ),
}

#: Upper case to lower, everything but letters, digits and bytes from 0x80 to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_ROWS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<word:int,n_words:int,label:string,containment:double>>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many rows each of the templates' words occurs, over all rows."""

    def count(batches):
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(vocabulary.intersection(words(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w.encode(): n for w, n in found}


def shape(text: str, threshold: float) -> tuple[int, int]:
    """Of a template: how many of its distinct words a block needs, and how many words a block has."""
    found = words(text)
    return max(1, math.ceil(threshold * len(set(found)) - 1e-9)), math.ceil(len(found) / threshold - 1e-9)


class Template:
    """A template's words as ranks from rare to common."""

    def __init__(self, label: str, text: str, names: str, rank: dict[bytes, int], threshold: float):
        self.label = label
        self.ordered = sorted({rank[w] for w in words(text)})
        self.place = {r: p for p, r in enumerate(self.ordered)}
        self.names = [rank[w] for w in set(words(names))]
        self.need, self.width = shape(text, threshold)
        self.prefix = frozenset(self.ordered[: len(self.ordered) - self.need + 1])

    def reaches(self, rank: int, ranks: list[int], a: int, b: int) -> bool:
        """The positional filter of a prefix word as the rarest one that a block shares with the template: of both ordered sets only words behind it can be shared as well.

        Of the block those are among the words of ranks[a:b] that are more frequent; it is asked before anything is intersected.
        """
        if b - a < self.need or len(self.ordered) - self.place[rank] < self.need:
            return False
        return 1 + len({r for r in ranks[a:b] if r > rank}) >= self.need


class Index:
    """The templates, and the order of their words by frequency."""

    def __init__(self, templates: dict[str, tuple[str, str]], seen: dict[bytes, int], threshold: float):
        vocabulary = {w for text, names in templates.values() for w in words(text) + words(names)}
        self.rank = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
        self.templates = [Template(label, text, names, self.rank, threshold) for label, (text, names) in sorted(templates.items()) if words(text)]
        self.prefix: dict[int, list[Template]] = {}
        for t in self.templates:
            for r in t.prefix:
                self.prefix.setdefault(r, []).append(t)

    def blocks(self, found: list[bytes]) -> Iterator[tuple[int, int, str, float]]:
        """First word, words, label and best containment of each block of a text's words."""
        hits = [(p, r) for p, w in enumerate(found) if (r := self.rank.get(w, -1)) >= 0]
        places, ranks = [p for p, _ in hits], [r for _, r in hits]
        spans: dict[int, list[list[int]]] = {}  # of hits that a block around a prefix word can hold
        for k, r in enumerate(ranks):
            for t in self.prefix.get(r, ()):
                a, b = bisect_left(places, places[k] - t.width + 1), bisect_left(places, places[k] + t.width)
                if not t.reaches(r, ranks, a, b):
                    continue
                held = spans.setdefault(id(t), [])
                if held and a <= held[-1][1]:
                    held[-1][1] = b
                else:
                    held.append([a, b])
        for t in self.templates:
            for a, b in spans.get(id(t), ()):
                part = [(p, r) for p, r in hits[a:b] if r in t.place]
                if len({r for _, r in part}) >= t.need:
                    yield from self._verified(t, part)

    @staticmethod
    def _verified(t: Template, part: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, float]]:
        held: Counter[int] = Counter()
        end, distinct, block = 0, 0, None
        for p, r in part:
            while end < len(part) and part[end][0] < p + t.width:
                distinct += not held[part[end][1]]
                held[part[end][1]] += 1
                end += 1
            if distinct >= t.need and all(held[x] for x in t.names):
                last, share = part[end - 1][0], distinct / len(t.ordered)
                if block and p <= block[1]:
                    block = [block[0], max(block[1], last), max(block[2], share)]
                else:
                    if block:
                        yield block[0], block[1] - block[0] + 1, t.label, block[2]
                    block = [p, last, share]
            held[r] -= 1
            distinct -= not held[r]
        if block:
            yield block[0], block[1] - block[0] + 1, t.label, block[2]


def places(joined: bytes, phrases: list[tuple[bytes, str]]) -> tuple[int, int | None, int | None, set[str]]:
    """How often the phrases stand in words joined by single spaces (one at each end), first and last start, labels."""
    count, low, high, labels = 0, None, None, set()
    for phrase, label in phrases:
        at = joined.find(phrase)
        if at < 0:
            continue
        labels.add(label)
        start = joined.count(b" ", 0, at)
        low = start if low is None else min(low, start)
        while at >= 0:
            count, last = count + 1, at
            at = joined.find(phrase, at + 1)
        end = joined.count(b" ", 0, last)
        high = end if high is None else max(high, end)
    return count, low, high, labels


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Counts, labels, score (the best containment found, else 0) and matching blocks of each row.

    templates: by label, a text and the words that a block must have besides, or "".
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = Index(templates, frequencies(rows, frozenset(w for text, names in templates.values() for w in words(text) + words(names))), threshold)
    sought = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items()]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("word", pa.int32()), ("n_words", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = words(text.as_py() or "")
                count, low, high, base = places(b" " + b" ".join(found) + b" ", sought)
                blocks = [{"word": p, "n_words": n, "label": label, "containment": c} for p, n, label, c in index.blocks(found)]
                labels = base | {b["label"] for b in blocks}
                for column, x in zip(out, (doc_id.as_py(), len(found), count, low, high, ",".join(sorted(base)), ",".join(sorted(labels)), max((b["containment"] for b in blocks), default=0.0), blocks)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    return rows.mapInArrow(run, BLOCK_ROWS)


def _oracle() -> str:
    phrase = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    joined = lambda text: b" ".join(words(text)).decode()
    template = ", ".join(f"('{label}', '{joined(text)}', '{joined(names)}', {shape(text, 0.8)[0]}, {shape(text, 0.8)[1]})" for label, (text, names) in TEMPLATES.items())
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with rows as (
  select doc_id, row_number() over () as r, {fold.format("coalesce(text, '')")} as text from documents),
words as (
  select r, regexp_extract_all(text, '{pattern}') as w from rows),
phrases(p, label, n) as (values {phrase}),
templates as (select label, list_distinct(string_split(t, ' ')) as t, list_filter(string_split(names, ' '), lambda x: x <> '') as names, need, width from (values {template}) v(label, t, names, need, width)),
starts as (
  select r, i - 1 as pos, label from (select r, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 1), phrases
  where array_to_string(w[i : i + n - 1], ' ') = p),
base as (
  select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word from starts group by r),
vocabulary as (select label, need, width, len(t) as n, names, unnest(t) as word from templates),
places as (select r, unnest(range(len(w))) as pos, unnest(w) as word from words),
hits as (select r, label, need, width, n, names, pos, word from places join vocabulary using (word)),
enough as (select r, label from hits group by r, label, need having count(distinct word) >= need),
near as (select h.* from hits h join enough using (r, label)),
blocks as (
  select a.r, a.label, a.pos, count(distinct b.word) / a.n::double as c from near a join near b on a.r = b.r and a.label = b.label and b.pos >= a.pos and b.pos < a.pos + a.width
  group by a.r, a.label, a.pos, a.n, a.need, a.names having count(distinct b.word) >= a.need and len(list_intersect(list_distinct(list(b.word)), a.names)) = len(a.names)),
labels as (
  select r, string_agg(distinct label, ',' order by label) filter (where b) as base_labels, string_agg(distinct label, ',' order by label) as labels
  from (select r, label, true as b from starts union all select r, label, false from blocks) group by r),
scores as (select r, max(c) as score from blocks group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from rows join words using (r) left join base using (r) left join labels using (r) left join scores using (r)
"""


ORACLE = _oracle()
