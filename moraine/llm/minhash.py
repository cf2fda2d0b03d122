"""Near-duplicate groups by exact Jaccard similarity, candidates found by HyperMinHash.

1. A document is the set of 64-bit hashes of its distinct word shingles. Documents with the same
   set become one entry, so a group of copies costs one row from here on.
2. HyperMinHash: a hash deals the shingles of a set to ``BANDS * ROWS`` buckets; a bucket keeps its
   least value as a 16-bit register, a leading-zero count and ``MANTISSA`` bits behind the leading
   one. A bucket without shingles borrows the register of the first filled one in an order of its
   own, so that registers of two sets agree with a chance of their similarity, for short sets too.
3. ``ROWS`` registers are a band; entries that agree in a band are a group. At similarity 0.85 a pair
   shares none of the 28 bands of five with a chance of 7e-8. Groups with the same members are kept once.
4. Each entry is held against the least node of its groups: the estimate of the similarity first
   (agreeing registers less those expected to agree by chance of the compression), then the
   full sets. This joins most of a dense group, one pair an entry.
5. In groups that still hold several components, members outside the largest component are held against
   all members in another component, each pair only in the first band it shares. Groups are cut into
   blocks by members and by bytes of their sets, a task for each two. First registers alone say which
   members have an open pair; only their sets are sent. A task checks the most similar pairs
   first, on full sets, and leaves out pairs that are connected meanwhile.
6. Components of all links by alternating stars.

No candidate is dropped but by its sizes, which is exact, or by an estimate ``SIGMAS`` standard deviations
below the similarity asked for (a chance of 3e-7). What leaves a task is links of a forest, never all pairs.

Nulls, ties and odd inputs: a null text is empty; an empty set links with nothing, so each such row is
alone. Rows that repeat text or doc_id are rows each; two texts under one doc_id are two documents.
A row without doc_id gets the component of rows with the same set, if one of them has a doc_id, and is
not kept; else its component is null and it is kept. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .simhash import shingle_sets
from .words import mix, slices

BANDS, ROWS, MANTISSA = 28, 5, 10
BUCKETS = BANDS * ROWS
EMPTY = np.uint64(2**64 - 1)
SIGMAS = 5.0
BLOCK_ROWS = 4096
BLOCK_BYTES = 32_000_000
CELLS = 20_000_000
HOT_COPIES = 100_000
BROADCAST_KEYS = 500_000

#: Where an empty bucket looks for a filled one: a shuffled order of all buckets for each.
ORDERS = np.stack([np.argsort(mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(1 + b * BUCKETS))) for b in range(BUCKETS)])


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading-zero count and the bits behind the leading one of 64-bit values, in 16 bits."""
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))  # 53 bits, exactly
    zeros = (53 - exponent).astype(np.uint16)
    behind = np.where(fraction > 0, (2 * fraction - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | behind


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of each set; those of an empty set are 0."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.sum():
        return out
    h = np.concatenate(sets)
    bucket = ((h >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * BUCKETS, EMPTY)
    np.minimum.at(least, np.repeat(np.arange(len(sets)), sizes) * BUCKETS + bucket, mix(h + np.uint64(0x9E3779B97F4A7C15)))
    least = least.reshape(len(sets), BUCKETS)
    filled = least != EMPTY
    open_ = np.flatnonzero(~filled.all(1) & (sizes > 0))
    todo = ~filled[open_]
    for step in range(BUCKETS):
        if not len(open_):
            break
        source = ORDERS[:, step]
        good = todo & filled[open_][:, source]
        row, column = np.nonzero(good)
        least[open_[row], column] = least[open_[row], source[column]]
        todo &= ~good
        left = todo.any(1)
        open_, todo = open_[left], todo[left]
    out[sizes > 0] = compressed(least[sizes > 0])
    return out


def content(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set."""
    if not len(h):
        return 0, 0
    both = (mix(h).sum(dtype=np.uint64), mix(h ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
    return int(both[0].view(np.int64)), int(both[1].view(np.int64))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash of each band's registers."""
    wide = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(regs), BANDS), np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + wide[:, :, k] + np.uint64(1))
    return key


def floor_of(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The least share of agreeing registers with which sets of n and m shingles can't be ruled out.

    Registers of different shingles agree when both minima fall in one cell of the compression, a chance of
    nm / (n + m)^2 / (2 ln 2) / 2^MANTISSA: minima are exponential, cells as wide as their place allows.
    A set fills ``BUCKETS * (1 - exp(-n / BUCKETS))`` buckets; the others repeat those.
    """
    n, m = n.astype(np.float64), m.astype(np.float64)
    chance = n * m / (n + m) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)
    filled = BUCKETS * -np.expm1(-np.minimum(n, m) / BUCKETS)
    least = similarity - SIGMAS * np.sqrt(similarity * (1 - similarity) / filled)
    return chance + (1 - chance) * least


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(-1, BUCKETS)


class Group:
    """Members of a block of a band's group, and their open pairs: places below those of ``rest`` first."""

    def __init__(self, table: pa.Table, percent: int):
        self.node = table["node"].to_numpy()
        self.n = table["n"].to_numpy()
        self.label = table["label"].to_numpy()
        self.regs = matrix(table["regs"])
        self.left = np.flatnonzero(table["left"].to_numpy(zero_copy_only=False))
        self.right = np.flatnonzero(table["right"].to_numpy(zero_copy_only=False))
        self.rest = table["rest"].to_numpy(zero_copy_only=False)
        self.band, self.percent = table["band"][0].as_py(), percent

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of both members and the share of agreeing registers."""
        step = max(1, CELLS // (BUCKETS * max(1, len(self.right))))
        for at in range(0, len(self.left), step):
            a = self.left[at : at + step]
            b = self.right
            good = self.label[a][:, None] != self.label[b][None, :]
            # Of two members of the rest the lesser node asks.
            good &= ~self.rest[b][None, :] | (self.node[a][:, None] < self.node[b][None, :])
            low, high = np.minimum(self.n[a][:, None], self.n[b][None, :]), np.maximum(self.n[a][:, None], self.n[b][None, :])
            good &= 100 * low >= self.percent * high
            i, j = np.nonzero(good)
            for k in range(0, len(i), CELLS // BUCKETS):
                x, y = a[i[k : k + CELLS // BUCKETS]], b[j[k : k + CELLS // BUCKETS]]
                same = self.regs[x] == self.regs[y]
                bands = same.reshape(-1, BANDS, ROWS).all(2)
                share = same.mean(1)
                good = (bands.argmax(1) == self.band) & (share >= floor_of(self.n[x], self.n[y], self.percent / 100))
                yield x[good], y[good], share[good]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept of each row.

    Documents link when 100 * intersection >= percent * union of their sets of shingles.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("regs", pa.binary())])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["text"]):
                sets = list(shingle_sets(batch["text"].slice(at, to - at), shingle))
                both = np.array([content(x) for x in sets], np.int64).reshape(-1, 2)
                regs = [x.tobytes() for x in registers(sets)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, to - at), pa.array([len(x) for x in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(regs, pa.binary())], schema=drawn)

    rows = cut(keyed.mapInArrow(sketched, "doc_id long, n long, node long, check long, regs binary"))
    entries = cut(rows.where("n > 0 and doc_id is not null").groupBy("node", "check", "n", "regs").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))

    def banded(batches):
        for batch in batches:
            keys = band_keys(matrix(batch["regs"]))
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch["node"].to_numpy(), BANDS))], names=["band", "key", "node"])

    bands = entries.select("node", "regs").mapInArrow(banded, "band int, key long, node long")
    group = ["band", "key"]
    several = bands.groupBy(*group).agg(F.count("*").alias("members"), F.min("node").alias("lead"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y")).where("members > 1")
    chosen = several.groupBy("members", "lead", "x", "y").agg(F.min(F.struct(*group)).alias("g")).select("g.*", "lead")
    members = cut(bands.join(chosen, group))

    # A pair for each entry, with the least of its groups' leaders.
    star = members.where("node <> lead").groupBy(F.col("node").alias("v")).agg(F.min("lead").alias("u"))
    own = entries.select("node", "n", "regs")
    side = lambda end, k: own.select(F.col("node").alias(end), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))

    def likely(batches):
        for batch in batches:
            n, m = batch["n0"].to_numpy(), batch["n1"].to_numpy()
            share = (matrix(batch["r0"]) == matrix(batch["r1"])).mean(1)
            good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (share >= floor_of(n, m, percent / 100))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(good))

    pairs = cut(star.join(side("u", 0), "u").join(side("v", 1), "v").select("u", "v", "n0", "n1", "r0", "r1").mapInArrow(likely, "u long, v long"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node and hashes of its whole set, from the text of one of its documents."""
        wanted = nodes.distinct().join(entries.select("node", F.col("first").alias("id")), "node")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted

        def run(batches):
            for batch in batches:
                found = list(shingle_sets(batch["text"], shingle))
                mine = pa.array([content(x)[0] for x in found], pa.int64())
                good = pa.compute.equal(mine, batch["node"])  # other texts can have the same doc_id
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "hashes"]).filter(good)

        texts = keyed.join(side, F.col("doc_id") == F.col("id")).select("node", "text")
        return texts.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])

    def verified(batches):
        for batch in batches:
            good = [linked(*(np.frombuffer(z.as_py(), np.uint64) for z in ab), percent) for ab in zip(batch["a"], batch["b"])]
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    sets = cut(sets_of(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v"))))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    first_links = cut(both.select("u", "v", "a", "b").mapInArrow(verified, "u long, v long"))
    roots = components(first_links)

    # Groups of several components: what is outside the largest meets all.
    labelled = cut(members.select(*group, "node").join(roots, "node", "left").join(own.select("node", "n"), "node").select(*group, "node", "n", F.coalesce("root", "node").alias("label")))
    parts = labelled.groupBy(*group, "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    open_groups = (
        parts.groupBy(*group)
        .agg(F.count("*").alias("parts"), F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        .where("parts > 1")
        .select(*group, F.col("most.label").alias("main"), F.ceil(F.greatest(F.col("c") / BLOCK_ROWS, F.col("s") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    piece = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    marked = labelled.join(open_groups, group).select(*group, "node", "n", "label", "blocks", (F.col("label") != F.col("main")).alias("rest"), piece.alias("piece"))
    # Block (i, j): the rest of piece i against all of piece j.
    as_right = marked.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("piece").alias("j"))
    as_left = marked.where("rest and blocks > 1").select("*", F.col("piece").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).where("i <> j")
    cell = [*group, "i", "j"]
    dealt = as_right.withColumn("right", F.lit(True)).withColumn("left", F.expr("rest and i = j")).unionByName(as_left.withColumn("right", F.lit(False)).withColumn("left", F.lit(True)))
    ready = cut(dealt.select(*cell, "node", "n", "label", "rest", "left", "right").join(own.select("node", "regs"), "node"))

    def active(table: pa.Table) -> pa.Table:
        own_pairs = Group(table, percent)
        seen = np.zeros(len(own_pairs.node), bool)
        for x, y, _ in own_pairs.pairs():
            seen[x] = seen[y] = True
        return table.filter(pa.array(seen))

    def settle(table: pa.Table) -> pa.Table:
        block = Group(table, percent)
        found = list(block.pairs())
        x, y, share = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        order = np.argsort(-share, kind="stable")
        x, y = x[order], y[order]
        label, u, v = block.label.copy(), [], []
        at = 0
        while at < len(x):
            part = np.arange(at, min(len(x), at + 1000))
            at = part[-1] + 1
            for k in part[label[x[part]] != label[y[part]]]:
                a, b = int(x[k]), int(y[k])
                if label[a] != label[b] and linked(np.frombuffer(table["hashes"][a].as_py(), np.uint64), np.frombuffer(table["hashes"][b].as_py(), np.uint64), percent):
                    u.append(block.node[a])
                    v.append(block.node[b])
                    label[label == label[b]] = label[a]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    columns = "band int, key long, i int, j int, node long, n long, label long, rest boolean, left boolean, right boolean, regs binary"
    names = [c.split()[0] for c in columns.split(", ")]
    busy = cut(ready.select(*names).groupBy(*cell).applyInArrow(active, columns))
    more = busy.join(sets_of(busy.select("node")), "node").select(*names, "hashes").groupBy(*cell).applyInArrow(settle, "u long, v long")

    roots = components(first_links.unionAll(more))
    rooted = entries.join(roots, "node", "left").select("node", "check", "first", "copies", F.coalesce("root", "node").alias("root"))
    classes = cut(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "check", "copies", "component_id"))
    # Entries of many copies, less than one for each HOT_COPIES rows, go to every task.
    hot = F.broadcast(classes.where(F.col("copies") > HOT_COPIES).drop("copies"))
    some = rows.where("n > 0").select("doc_id", "n", "node", "check")
    key = ["node", "check"]
    placed = some.join(hot, key).unionByName(some.join(hot, key, "left_anti").join(classes.where(F.col("copies") <= HOT_COPIES).drop("copies"), key, "left"))
    alone = rows.where("n = 0").select("doc_id", "n", "node", "check", F.col("doc_id").alias("component_id"))
    kept = F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return placed.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
