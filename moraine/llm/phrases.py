"""Phrase collocations by contiguous pattern growth over projected occurrence pointers.

1. Blocks of text count their words; sums over all blocks give f of every word and n of every language.
   A word's hash includes its language, so languages never meet. Words under ``least`` can't be part of a phrase: a bitmap
   of ``SLOTS`` bits, of that size for any vocabulary, tells a block which words those are (it may keep some too many).
2. Every occurrence of a frequent word that another follows in its piece becomes a pointer: the word and the two behind
   it. A block adds equal pointers up and sends them packed to the task of their prefix, the first word.
   A prefix that holds more than one in ``SHARE`` of all words is split by the second word, and a
   pair of words that does so by the third; there are at most ``SHARE`` of each.
3. A task sorts its pointers, so that each prefix is a range, and grows to the right: ranges that are frequent are kept and
   extended by their next word, down to the longest phrase, before the task returns. Only pairs
   that were split are sums over tasks.
4. Counts of parts come from joins of the frequent phrases with each other and with the frequent words. Scores
   are exact in decimals of 38 digits: a may reach 10^16.

Nulls, ties and odd inputs: a null text is empty, a null language is ``und``; rows that repeat count each time, whatever
their doc_id; equal scores go to the larger a, then to the smaller phrase by bytes. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .words import mix, slices, text_buffers, word_bounds, word_hashes

BLOCK_BYTES = 2_000_000
TASK_POINTERS = 1_000_000
MOST_TASKS = 65_536
FOLD = 4_000_000
SHARE = 4096
SLOTS = 1 << 24

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Words:
    """Words of a block of texts: hashes that include the language, places, and whether the next is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_buffers(batch["text"])
        self.data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.starts, self.ends, first = word_bounds(self.data, offsets, _GAP)
        langs = batch["lang"].dictionary_encode()
        names = np.array([xxhash.xxh64_intdigest(x.as_py().encode()) for x in langs.dictionary], np.uint64)
        counts = np.diff(first)
        self.rows = np.repeat(np.arange(len(counts)), counts)
        self.langs = langs
        self.h = mix(word_hashes(self.data, self.starts, self.ends) + np.repeat(names[langs.indices.to_numpy()], counts)) if len(counts) else np.empty(0, np.uint64)
        breaks = np.cumsum(_BREAK[self.data])
        at = breaks[self.starts] if len(self.starts) else np.empty(0, np.int64)
        self.on = np.zeros(len(self.h), bool)
        self.on[:-1] = (self.rows[1:] == self.rows[:-1]) & (at[1:] == at[:-1])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for at, to in slices(batch["text"], BLOCK_BYTES):
            yield Words(batch.slice(at, to - at))


COUNTS = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("word", pa.string()), ("c", pa.int64())])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: words by language (kind 0), each word (1), and pairs that hold more than one in SHARE of its words (2)."""
    for words in blocks(batches):
        n = len(words.h)
        if not n:
            continue
        lang = np.asarray(words.langs.indices)[words.rows]
        total = np.bincount(lang, minlength=len(words.langs.dictionary))
        names, first, own, count = np.unique(words.h, return_index=True, return_inverse=True, return_counts=True)
        texts = [words.data[s:e].tobytes().decode() for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist())]
        at = np.flatnonzero(words.on & (count[own] * SHARE >= n))
        pairs, many = np.unique(own[at].astype(np.uint64) * np.uint64(len(names)) + own[at + 1].astype(np.uint64), return_counts=True)
        pairs, many = pairs[many * SHARE >= n], many[many * SHARE >= n]
        p, q = names[(pairs // np.uint64(len(names))).astype(np.int64)], names[(pairs % np.uint64(len(names))).astype(np.int64)]
        zero, none = np.zeros(len(total) + len(names), np.int64), pa.nulls
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1, 2], np.int32), [len(total), len(names), len(p)])),
                pa.concat_arrays([words.langs.dictionary.cast(pa.string()), words.langs.dictionary.take(pa.array(lang[first])).cast(pa.string()), none(len(p), pa.string())]),
                pa.array(np.concatenate((zero[: len(total)], names.view(np.int64), p.view(np.int64)))),
                pa.array(np.concatenate((zero, q.view(np.int64)))),
                pa.concat_arrays([none(len(total), pa.string()), pa.array(texts, pa.string()), none(len(p), pa.string())]),
                pa.array(np.concatenate((total, count, many)).astype(np.int64)),
            ],
            schema=COUNTS,
        )


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows of sorted columns differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def folded(pointers: list[np.ndarray]) -> list[np.ndarray]:
    """Pointers in order, equal ones added up; the last column is their count."""
    order = np.lexsort(pointers[2::-1])
    columns = [x[order] for x in pointers]
    at = runs(columns[:3])
    return [*(x[at] for x in columns[:3]), np.add.reduceat(columns[3], at) if len(at) else columns[3]]


def grown(pointers: list[np.ndarray], depth: int, least: int, often: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(h1, h2, h3, count) of the frequent phrases of ``depth`` words and of their extensions; pointers in order."""
    at = runs(pointers[:depth])
    if not len(at):
        return
    count = np.add.reduceat(pointers[3], at)
    first = [x[at] if k < depth else np.zeros(len(at), np.uint64) for k, x in enumerate(pointers[:3])]
    good = count >= least
    # Prefixes that are split are sums over tasks.
    if depth == 1:
        good |= np.isin(first[0], often)
    if depth == 2:
        good |= np.isin(pair_key(first[0], first[1]), hot)
    if depth > 1:
        yield (*(x[good] for x in first), count[good])
    if depth < 3:
        inside = np.repeat(good, np.diff(np.append(at, len(pointers[0])))) & (pointers[depth] != 0)
        yield from grown([x[inside] for x in pointers], depth + 1, least, often, hot)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b)


def score(left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)), exactly."""
    a, product = "cast(a as decimal(18, 0)) * cast(a as decimal(18, 0)) * 1000000", f"cast({left} as decimal(18, 0)) * cast({right} as decimal(18, 0))"
    return F.expr(f"({a}) div ({product})")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, held_percent: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of two or three words.

    A phrase that occurs ``least`` times scores floor(10^6 a^2 / (l r)) at its weakest cut. It is dropped if a longer
    one that holds it occurs at least ``held_percent`` percent as often.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    sums = texts.mapInArrow(counted, "kind int, lang string, h1 long, h2 long, word string, c long").groupBy("kind", "lang", "h1", "h2", "word").agg(F.sum("c").alias("c"))
    counts = cut(sums.where((F.col("kind") != 1) | (F.col("c") >= least)))
    totals = counts.where("kind = 0").select("lang", F.col("c").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    # Not more than SHARE of each, whatever the size.
    share = F.col("c") * SHARE >= total
    often = np.array([r[0] for r in counts.where("kind = 1").where(share).select("h1").collect()], np.int64).view(np.uint64)
    pairs = np.array([tuple(r) for r in counts.where("kind = 2").where(share).select("h1", "h2").collect()], np.int64).reshape(-1, 2).view(np.uint64)
    hot = pair_key(pairs[:, 0], pairs[:, 1])
    vocabulary = counts.where("kind = 1").select("h1", "lang", "word", "c")
    slot = F.pmod("h1", F.lit(SLOTS))
    bits = np.zeros(SLOTS // 64, np.uint64)
    for word, mask in vocabulary.groupBy(F.floor(slot / 64).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h1, {SLOTS}) % 64 as int))")).alias("m")).collect():
        bits[word] = np.int64(mask).view(np.uint64)
    tasks = min(MOST_TASKS, max(1, math.ceil(total / TASK_POINTERS)))
    sent = pa.schema([("task", pa.int32()), *((x, pa.binary()) for x in ("h1", "h2", "h3", "c"))])

    def frequent(h: np.ndarray) -> np.ndarray:
        at = h % np.uint64(SLOTS)  # a power of two: as pmod of the signed value
        return (bits[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64))) & np.uint64(1) == 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in blocks(batches):
            h, good = words.h, frequent(words.h)
            at = np.flatnonzero(good[:-1] & good[1:] & words.on[:-1])
            if not len(at):
                continue
            after = np.minimum(at + 2, len(h) - 1)
            third = np.where((at + 2 < len(h)) & words.on[at + 1] & good[after], h[after], np.uint64(0))
            h1, h2, h3, c = folded([h[at], h[at + 1], third, np.ones(len(at), np.int64)])
            key = mix(h1)
            split = np.isin(h1, often)
            key = np.where(split, mix(key + h2), key)
            key = np.where(split & np.isin(pair_key(h1, h2), hot), mix(key + h3), key)
            task = (key % np.uint64(tasks)).astype(np.int32)
            order = np.argsort(task, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(task[order], prepend=-1)), len(order))
            pieces = [order[i:j] for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(task[order][ends[:-1]]), *(pa.array([x[p].tobytes() for p in pieces], pa.binary()) for x in (h1, h2, h3, c))], schema=sent)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, waiting = [np.empty(0, np.uint64)] * 3 + [np.empty(0, np.int64)], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                more.append([np.frombuffer(batch[x][k].as_py(), np.int64 if x == "c" else np.uint64) for x in ("h1", "h2", "h3", "c")])
                waiting += len(more[-1][0])
                if waiting > FOLD:
                    held, more, waiting = folded([np.concatenate(x) for x in zip(held, *more)]), [], 0
        for h1, h2, h3, c in grown(folded([np.concatenate(x) for x in zip(held, *more)]), 1, least, often, hot):
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (h1, h2, h3)), pa.array(c)], names=["h1", "h2", "h3", "a"])

    pointers = texts.mapInArrow(project, "task int, h1 binary, h2 binary, h3 binary, c binary")
    phrases = cut(pointers.groupBy("task").applyInArrow(grow, "h1 long, h2 long, h3 long, a long").groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a")).where(F.col("a") >= least))

    word = lambda k: vocabulary.select(F.col("h1").alias(f"h{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"w{k}"), F.col("c").alias(f"f{k}"))
    two = cut(phrases.where("h3 = 0").drop("h3").join(word(1), "h1").join(word(2), "h2"))
    three = phrases.where("h3 <> 0")
    longest = three.select("h1", "h2", "a").unionAll(three.select("h2", "h3", "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    free = two.join(longest, ["h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < held_percent * F.col("a")))
    front = two.select("h1", "h2", "lang", "w1", "w2", F.col("f1").alias("l1"), F.col("a").alias("l2"))
    back = two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("f2").alias("r2"))

    pair_rows = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    both = three.join(front, ["h1", "h2"]).join(back, ["h2", "h3"]).withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    three_rows = both.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pair_rows.unionByName(three_rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB: all phrases of one to three words counted.
ORACLE = r"""
with docs as (
  select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents where text is not null),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from docs),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
grams as (
  select lang, w[i] as w1, case when k > 1 then w[i + 1] end as w2, case when k > 2 then w[i + 2] end as w3, count(*)::bigint as f
  from places, (values (1), (2), (3)) ks(k) where i + k - 1 <= len(w) group by all),
one as (select lang, w1, f from grams where w2 is null),
n as (select lang, sum(f)::bigint as n from one group by lang),
two as (select lang, w1, w2, f from grams where w2 is not null and w3 is null),
three as (select lang, w1, w2, w3, f from grams where w3 is not null and f >= 10),
cuts as (
  select t.lang, t.w1 || ' ' || t.w2 as phrase, t.f as a, x.f as l, y.f as r, 1 as k
  from two t join one x on x.lang = t.lang and x.w1 = t.w1 join one y on y.lang = t.lang and y.w1 = t.w2
  where t.f >= 10 and not exists (select 1 from three h where h.lang = t.lang and ((h.w1 = t.w1 and h.w2 = t.w2) or (h.w2 = t.w1 and h.w3 = t.w2)) and 100 * h.f >= 50 * t.f)
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  from three t join one x on x.lang = t.lang and x.w1 = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  from three t join two x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join one y on y.lang = t.lang and y.w1 = t.w3),
scored as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) join n using (lang) where rank <= 2000
"""
