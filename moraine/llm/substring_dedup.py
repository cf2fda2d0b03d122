"""Substring deduplication by level-wise doubling.

Windows of ``window / 2^k`` words are fingerprinted first. Only those that occur more than once
are extended to twice the length, and so on up to ``window`` words: a window can repeat only
where both of its halves do. Every word covered by a window that starts earlier elsewhere
(smaller doc_id, or the same document further left) is removed.

Documents are dealt by a hash of doc_id into blocks of a few megabytes, and fingerprints by
their leading bits into buckets. At each level a block sends each *distinct* fingerprint of its
surviving windows once, packed, to its bucket; the bucket answers with one bit for each. So a
passage that a third of all documents hold costs one entry a block, not one a copy, nothing is
expanded into pairs, and the text is shuffled once, its exchange being reused at each level.
Blocks grow with the root of the table up to 64 MB, and there are as many buckets as blocks, so that
a packed row keeps many fingerprints; a block's work doesn't depend on their number.

Below the last level four bytes of a fingerprint go to its bucket; they only filter, and as a bucket's
size is bounded, so is the share of collisions, which cost nothing but work. At the last level six bytes
go, beside the bucket's own seven bits or more, and four of a second fingerprint from another hash of the words.

Nulls, ties and odd inputs: a null text has no words; a null doc_id counts as smaller than
all others, and such rows are dealt by their text; rows that repeat a doc_id are kept apart, ordered by their text, and count as one
document after another. An empty table gives an empty result. Columns other than ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import doubled, mix, text_buffers, word_bounds, word_hashes

LEAST_BYTES, MOST_BYTES = 4_000_000, 64_000_000
LEAST_BLOCKS = 128
SENT = "block int, bucket int, prints binary, owners binary"
FLAGS = "block int, bucket int, flags binary"
PACKED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("prints", pa.binary()), ("owners", pa.binary())])
_NULL_ID = np.iinfo(np.int64).min


class Block:
    """The words of one block's documents in order of doc_id, and its windows at each level."""

    def __init__(self, rows: pa.Table, base: int):
        ids = rows["doc_id"].combine_chunks().cast(pa.int64()).fill_null(_NULL_ID)
        texts = rows["text"].combine_chunks()
        order = pa.compute.sort_indices(pa.table({"i": ids, "t": texts}), [("i", "ascending"), ("t", "ascending")])
        self.rows = rows.take(order)
        self.ids = ids.take(order).to_numpy()
        data, offsets = text_buffers(self.rows["text"])
        starts, ends, first = word_bounds(data, offsets)
        self.words = (data, starts, ends)
        self.first = first
        self.base = self.length = base
        self.hashes = self.widened(word_hashes(*self.words))
        self.left = np.repeat(first[1:], np.diff(first)) - np.arange(len(starts))  # words from here to the text's end
        self.live = self.left >= base

    def widened(self, h: np.ndarray) -> np.ndarray:
        """Fingerprints of the first level's windows from hashes of single words."""
        out = np.zeros(max(0, len(h) - self.base + 1), np.uint64)
        for k in range(self.base):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(out)])
        return out

    def second(self) -> np.ndarray:
        """Fingerprints of this level's windows from another hash of the words."""
        h, length = self.widened(word_hashes(*self.words, 1)), self.base
        while length < self.length:
            h, length = doubled(h, length, 1), 2 * length
        return h

    def double(self, repeated: np.ndarray) -> None:
        """Keep the windows both of whose halves repeat, at twice the length."""
        half = self.length
        self.hashes, self.length = doubled(self.hashes, half), 2 * half
        self.live = self.left >= self.length
        n = len(self.hashes)
        self.live[:n] &= repeated[:n] & repeated[half : half + n]

    def distinct(self) -> tuple[np.ndarray, ...]:
        """Places of surviving windows; their distinct fingerprints, sorted; each one's first place, inverse and count."""
        at = np.flatnonzero(self.live)
        prints, first, inverse, count = np.unique(self.hashes[at], return_index=True, return_inverse=True, return_counts=True)
        return at, prints, at[first], inverse, count

    @staticmethod
    def buckets(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of sorted fingerprints, and where each begins (one more at the end)."""
        bucket = (prints >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return bucket[starts], np.append(starts, len(prints))

    def send(self, key: int, bits: int, last: bool) -> pa.Table:
        _, prints, first, _, _ = self.distinct()
        held, cuts = self.buckets(prints, bits)
        extra = (self.second()[first] >> np.uint64(32)).astype(np.uint32) if last else None
        owner = self.ids[np.searchsorted(self.first, first, "right") - 1] if last else None
        packed, owners = [], []
        for i, j in zip(cuts[:-1], cuts[1:]):
            low = prints[i:j].astype(np.uint32).tobytes()
            packed.append((prints[i:j] >> np.uint64(32)).astype(np.uint16).tobytes() + low + extra[i:j].tobytes() if last else low)
            owners.append(_offsets(owner[i:j]) if last else None)
        return pa.table([pa.array(np.full(len(held), key, np.int32)), pa.array(held.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(owners, pa.binary())], schema=PACKED)

    def receive(self, flags: pa.Table, bits: int, last: bool) -> np.ndarray:
        """Which windows repeat; at the last level, which of them start earlier elsewhere."""
        at, prints, first, inverse, count = self.distinct()
        elsewhere = np.zeros(len(prints), bool)
        held, cuts = self.buckets(prints, bits)
        for k, packed in zip(np.searchsorted(held, flags["bucket"].to_numpy()), flags["flags"].to_pylist()):
            i, j = cuts[k], cuts[k + 1]
            elsewhere[i:j] = np.unpackbits(np.frombuffer(packed, np.uint8), count=j - i).view(bool)
        out = np.zeros(len(self.left), bool)
        out[at] = elsewhere[inverse] | (at != first[inverse] if last else (count > 1)[inverse])
        return out


def _offsets(ids: np.ndarray) -> bytes:
    """The least id, and the others from it in four bytes each if they fit, else all in eight."""
    least = int(ids.min())
    if int(ids.max()) - least < 1 << 32:
        return np.int64(least).tobytes() + (ids - least).astype(np.uint32).tobytes()
    return np.int64(least).tobytes() + ids.tobytes()


def _from_offsets(data: bytes, n: int) -> np.ndarray:
    if len(data) == 8 + 4 * n:
        return np.frombuffer(data, np.uint32, n, 8).astype(np.int64) + np.frombuffer(data, np.int64, 1)
    return np.frombuffer(data, np.int64, n, 8)


def _answer(rows: pa.Table, last: bool) -> pa.Table:
    """One bucket: a bit for each fingerprint of each block."""
    sent = rows["prints"].to_pylist()
    sizes = [len(x) // (10 if last else 4) for x in sent]
    ends = np.cumsum(sizes)
    if last:
        a = np.concatenate([(np.frombuffer(x, np.uint16, n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(x, np.uint32, n, 2 * n) for x, n in zip(sent, sizes)])
        b = np.concatenate([np.frombuffer(x, np.uint32, n, 6 * n) for x, n in zip(sent, sizes)])
        owner = np.concatenate([_from_offsets(x, n) for x, n in zip(rows["owners"].to_pylist(), sizes)])
        order = np.lexsort((np.repeat(rows["block"].to_numpy(), sizes), owner, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        flag = np.zeros(len(a), bool)
        flag[order[1:]] = same  # all but the smallest owner of each fingerprint
    else:
        v = np.concatenate([np.frombuffer(x, np.uint32) for x in sent])
        order = np.argsort(v)
        same = v[order][1:] == v[order][:-1]
        flag = np.zeros(len(v), bool)
        flag[order[1:]] |= same
        flag[order[:-1]] |= same
    packed = [np.packbits(flag[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return pa.table({"block": rows["block"], "bucket": rows["bucket"], "flags": pa.array(packed, pa.binary())})


def _replay(rows: pa.Table, flags: pa.Table, base: int, level: int, bits: int) -> Block:
    """The block after the levels below; the rows of flags have them in their column ``level``."""
    block = Block(rows, base)
    for k in range(level):
        mine = flags.filter(pa.compute.equal(flags["level"], k))
        block.double(block.receive(mine, bits, False))
    return block


def substring_dedup(docs: DataFrame, window: int = 20, levels: int = 2, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of each row.

    window: words of a window, a multiple of ``2^levels``; levels: how often the first
    level's length is doubled; block_bytes: text of a block, else by the table's size.
    """
    base = window >> levels
    if base < 1 or base << levels != window:
        raise ValueError("window must be a positive multiple of 2^levels")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(size / (block_bytes or min(MOST_BYTES, max(LEAST_BYTES, 64 * math.isqrt(size))))))
    bits = max(7, math.ceil(math.log2(blocks)))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = named.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    dealt = rows.groupBy("block")

    def first_level(key, table):
        return Block(table, base).send(key[0].as_py(), bits, levels == 0)

    def next_level(level):
        def send(key, left, right):
            return _replay(left, right, base, level, bits).send(key[0].as_py(), bits, level == levels) if left.num_rows else PACKED.empty_table()

        return send

    def answer(last):
        return lambda table: _answer(table, last)

    known = None
    for level in range(levels + 1):
        sent = dealt.applyInArrow(first_level, SENT) if known is None else dealt.cogroup(known.groupBy("block")).applyInArrow(next_level(level), SENT)
        flags = sent.groupBy("bucket").applyInArrow(answer(level == levels), FLAGS).withColumn("level", F.lit(level))
        known = flags if known is None else known.unionByName(flags)

    def finish(left, right):
        if not left.num_rows:
            return pa.table({"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}, out)
        block = _replay(left, right, base, levels, bits)
        repeats = block.receive(right.filter(pa.compute.equal(right["level"], levels)), bits, True)
        edges = np.zeros(len(block.left) + 1, np.int64)
        at = np.flatnonzero(repeats)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + window, -1)
        gone = np.cumsum(edges[:-1]) > 0
        before = np.concatenate(([0], np.cumsum(gone)))
        removed = before[block.first[1:]] - before[block.first[:-1]]
        kept = []
        for text, n, i, j in zip(block.rows["text"].to_pylist(), removed, block.first[:-1], block.first[1:]):
            words = (text or "").encode().split() if n < j - i else []
            kept.append(b" ".join([w for w, g in zip(words, gone[i:j].tolist()) if not g] if n else words).decode())
        return pa.table({"doc_id": block.rows["doc_id"], "n_words": np.diff(block.first), "n_removed": removed, "kept_text": kept}, out)

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    return dealt.cogroup(known.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")
