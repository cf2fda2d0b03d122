"""Line deduplication by pairwise alignment of documents that share lines.

1. Lines are hashed; lines of ``min_chars`` or more are looked up. The smallest doc_id that holds
   a line owns it, and every later document with that line is paired with the owner: at most one
   pair for each line of a document, however many documents share it. A document with shorter lines only
   is looked up as a whole.
2. A line is rare if at most ``rare`` documents hold it. A pair overlaps if it shares a rare line
   or two lines of any frequency. A looked-up line above ``rare`` needs no pair: it is deleted
   wherever it stands in a document later than its owner. So is all of a later copy of a text of short lines.
3. Each pair is aligned with patience diff over line hashes (of another seed than the lookup's).
4. A common block, lines that follow each other in both documents, is deleted from the later
   document if it holds a rare line or at least two lines that are looked up.
5. If a looked-up line of the owner is left, as it is repeated or moved, every run of lines that
   stands anywhere in the owner counts as a common block (suffix automaton). So no looked-up line
   stays that an earlier document holds.

Line groups are only aggregated (least id, count) and joined under a salt, never gathered, so a line on
a third of all documents is spread over tasks. Later documents are sent to their owners in buckets; an owner of more than
``HOT_PAIRS`` of them is in many buckets, once in each, and is read once for all of a bucket.

Nulls, ties and odd inputs: a null text has no lines and stays null; a row without doc_id is kept
whole and owns nothing; rows that share a doc_id are compared with smaller ids only, not with
each other; an empty table gives an empty result. Columns other than ``doc_id`` and ``text``
are carried only if named in ``carry``, in a struct of their own.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SALTS = 16
BUCKET_PAIRS = 1_000
HOT_PAIRS = 2_000
LEAST_BUCKETS = 128


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, given by their first, whose seconds increase."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two sequences: equal ends, then lines unique in both, then between those."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, n = todo.pop()
        while i < k and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < n and a[k - 1] == b[n - 1]:
            k, n = k - 1, n - 1
            out.append((k, n))
        if i == k or j == n:
            continue
        once_a: dict[int, int] = {}
        once_b: dict[int, int] = {}
        for once, lines, start, end in ((once_a, a, i, k), (once_b, b, j, n)):
            for p in range(start, end):
                once[lines[p]] = -1 if lines[p] in once else p
        anchors = _increasing([(p, once_b[x]) for x, p in once_a.items() if p >= 0 and once_b.get(x, -1) >= 0])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (k, n)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if q > p + 1 and s > r + 1]
    return sorted(out)


def runs(a: list[int], b: list[int]) -> list[int]:
    """At each place of a, how many lines up to it (itself too) stand as one run anywhere in b."""
    # The suffix automaton of b: moves, suffix link and longest run of each state.
    moves: list[dict[int, int]] = [{}]
    link, most, last = [-1], [0], 0
    for x in b:
        new = len(moves)
        moves.append({})
        link.append(0)
        most.append(most[last] + 1)
        p = last
        while p >= 0 and x not in moves[p]:
            moves[p][x] = new
            p = link[p]
        if p >= 0:
            q = moves[p][x]
            if most[q] == most[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                most.append(most[p] + 1)
                while p >= 0 and moves[p].get(x) == q:
                    moves[p][x] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out, at, n = [], 0, 0
    for x in a:
        while at and x not in moves[at]:
            at = link[at]
            n = most[at]
        if x in moves[at]:
            at, n = moves[at][x], n + 1
        out.append(n)
    return out


def doomed(a: list[int], b: list[int], long: list[bool], rare: set[int]) -> list[int]:
    """Places in a of the common blocks that are deleted."""
    out = _aligned(a, b, long, rare)
    theirs = set(b)
    left = set(range(len(a))).difference(out)
    if not any(long[i] and a[i] in theirs for i in left):
        return out
    # Repeated or moved: every run of a that stands anywhere in b.
    scarce, looked = ([0, *accumulate(x)] for x in ((x in rare for x in a), long))
    start = len(a)
    for i, n in reversed([*enumerate(runs(a, b))]):
        if n and (scarce[i + 1] > scarce[i + 1 - n] or looked[i + 1] - looked[i + 1 - n] > 1):
            start = min(start, i + 1 - n)
        if start <= i and i in left:
            out.append(i)
    return out


def _aligned(a: list[int], b: list[int], long: list[bool], rare: set[int]) -> list[int]:
    """Places in a of the blocks that patience alignment finds."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (len(a) + 2, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(long[x] for x in block) > 1 or any(a[x] in rare for x in block):
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def deletions(docs: DataFrame, rare: int = 100, min_chars: int = 20) -> DataFrame:
    """(doc_id, copy, gone): the places of the lines that each document, named by id and hash of its text, loses."""
    known = docs.where("doc_id is not null and text is not null")
    copy = F.xxhash64("text").alias("copy")
    split = F.split("text", "\n")
    lines = F.transform(split, lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("h"), (F.length(x) >= min_chars).alias("long")))
    signed = known.select("doc_id", copy, lines.alias("lines"))
    entry = lambda line, h: F.struct(line.alias("line"), h.cast("long").alias("h"))
    long = F.array_distinct(F.transform(F.filter(split, lambda x: F.length(x) >= min_chars), lambda x: entry(F.xxhash64(x), F.xxhash64(F.lit(1), x))))
    whole = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.array(entry(F.xxhash64(F.lit(2), "text"), F.lit(None)))).otherwise(F.filter(F.array(entry(F.lit(0).cast("long"), F.lit(None))), lambda _: F.lit(False)))
    held = known.select("doc_id", copy, F.explode(F.when(F.size(long) > 0, long).otherwise(whole)).alias("x")).select("doc_id", "copy", "x.line", "x.h")
    owners = held.groupBy("line").agg(F.min("doc_id").alias("owner"), F.count("*").alias("df")).where("df > 1")
    salted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"]).where("doc_id > owner")
    scarce, often = (F.collect_list(F.when(x, F.col("h"))) for x in (F.col("df") <= rare, F.col("df") > rare))
    shared = cut(met.groupBy("doc_id", "copy", "owner").agg(F.count("h").alias("shared"), scarce.alias("rare"), often.alias("often"), F.bool_or(F.col("h").isNull()).alias("whole")))
    # Whole copies and frequent lines need no owner.
    direct = shared.where((F.size("often") > 0) | F.col("whole")).groupBy("doc_id", "copy").agg(F.flatten(F.collect_list("often")).alias("sought"), F.bool_or("whole").alias("whole"))
    pairs = shared.where((F.size("rare") > 0) | (F.col("shared") > 1)).select("doc_id", "copy", "owner", F.col("rare").alias("sought"), F.lit(False).alias("whole"))
    asked = pairs.unionByName(direct.withColumn("owner", F.lit(None).cast("long")))
    return _places(asked, signed).groupBy("doc_id", "copy").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _places(asked: DataFrame, signed: DataFrame) -> DataFrame:
    """(doc_id, copy, gone) of what loses lines.

    asked: doc_id, copy and owner, to be aligned with it by the rare lines ``sought``; or no owner, to lose all lines ``sought`` or, if ``whole``, all.
    signed: doc_id, copy, lines.
    """
    pairs = asked.where("owner is not null")
    buckets = max(LEAST_BUCKETS, math.ceil(asked.count() / BUCKET_PAIRS))
    # Less than one for each HOT_PAIRS pairs.
    hot = F.broadcast(pairs.groupBy("owner").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PAIRS).select("owner", F.ceil(F.col("n") / BUCKET_PAIRS).cast("int").alias("many")))
    bucket = F.pmod(F.xxhash64("owner", "salt"), F.lit(buckets)).cast("int").alias("bucket")
    many = F.coalesce("many", F.when(F.col("owner").isNull(), buckets).otherwise(1))
    later = asked.join(signed.distinct(), ["doc_id", "copy"]).join(hot, "owner", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy"), many).cast("int"))
    later = later.select(bucket, "owner", "doc_id", "copy", F.col("lines.h").alias("mine"), F.col("lines.long").alias("long"), "sought", "whole")
    leads = pairs.select("owner").distinct().join(hot, "owner", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))
    first = signed.groupBy("doc_id").agg(F.min(F.struct("copy", "lines")).alias("x")).select(F.col("doc_id").alias("owner"), F.col("x.lines.h").alias("theirs"))
    theirs = leads.join(first, "owner").select(bucket, F.col("owner").alias("lead"), "theirs")
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def align(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {owner: k for k, owner in enumerate(left["lead"].to_pylist())}
        last, lines, rows, out = None, [], [], []
        for k in pa.compute.sort_indices(right["owner"]).to_pylist():
            owner, mine, sought = (right[c][k].as_py() for c in ("owner", "mine", "sought"))
            if owner is None:
                often = set(sought)
                gone = list(range(len(mine))) if right["whole"][k].as_py() else [i for i, x in enumerate(mine) if x in often]
            else:
                if owner != last:
                    last, lines = owner, left["theirs"][held[owner]].as_py()
                gone = doomed(mine, lines, right["long"][k].as_py(), set(sought))
            if gone:
                rows.append(k)
                out.append(gone)
        at = pa.array(rows, pa.int64())
        return pa.table([right["doc_id"].take(at), right["copy"].take(at), pa.array(out, schema.field("gone").type)], schema=schema)

    return theirs.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(align, "doc_id long, copy long, gone array<int>")


def line_dedup(docs: DataFrame, rare: int = 100, min_chars: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of each row; ``carried`` if asked for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    gone = deletions(rows, rare, min_chars)
    joined = rows.withColumn("copy", F.xxhash64("text")).join(gone, ["doc_id", "copy"], "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        *(["carried"] if carry else []),
    )
