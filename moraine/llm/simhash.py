"""Near-duplicate groups by SimHash fingerprints and generalised pigeonhole search.

1. Fingerprints: hashes of word shingles, majority by bit. ``near_duplicates`` takes XXH64 and links
   fingerprints; ``one_of_each`` takes the distinct shingles and links by their Jaccard similarity.
2. Copies of one fingerprint become one entry, so a group of copies costs one row from here on.
3. The 64 x 64 co-occurrence of bits over all entries groups correlated bits into parts.
4. If a pair differs in at most ``distance`` bits, then for any thresholds t_i >= -1 with
   sum(t_i + 1) = distance + 1 some part i differs in at most t_i bits. Dynamic programming over
   the parts picks the thresholds that cost least: probes sent plus candidates expected, these
   from the bits' frequencies over all entries. The number of parts is chosen the same way.
   With several words each is searched by its own plan, and any of them may find a pair.
5. Each entry is sent once a part as an index row and once for every greater value within t_i of its
   part as a probe, so that a pair meets once. Rows travel packed by chunk (a hash range of part
   values). A chunk verifies whole fingerprints and emits a minimum spanning forest of its links,
   the nearest first: less rows than entries, however dense a group is.
6. A value that many entries share is searched by pivots: entries near the middle of the group are
   held against all others, which joins dense groups in a few passes; only entries outside the
   largest component are then held against all. Chunks above ``CHUNK_ROWS`` are cut into blocks of
   entries, a task for each two blocks.
7. Components of all forests by alternating stars.
8. ``one_of_each`` searches fingerprints only as far as a fixed work an entry allows, and then exactly for all links
   between groups (``crossing``): prefixes of the shingle sets, rare shingles first, meet by hash; pairs
   that share enough of them are compared in full.

Nothing but bit counts and common shingles of a sample, of constant size, and the sizes of chunks above the
limit reach the driver.

Nulls, ties and odd inputs of ``near_duplicates``: a null or wordless text has fingerprint zero and is
linked like any other; a row without doc_id gets its fingerprint and its own class's component, but
passes no link on if no row of its class has a doc_id; rows that share a doc_id are one node. An empty
table gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored.

Of ``one_of_each``: wordless texts, null or not, are copies of each other; rows are told apart by doc_id
and text, and repeated rows are copies; a row without doc_id is kept only if no row of its group has
one; all columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .words import mix, slices, text_buffers, word_bounds, word_hashes

CHUNK_BYTES = 4_000_000
CHUNK_ROWS = 2_000_000
LEAST_CHUNKS_BITS = 7
SLICE = 250_000
HOT_PAIRS = 500_000
HOT_ROWS = 100_000
PIVOTS = 64
ROW_COST = 300.0  # sending a row costs as much as checking so many candidates
BROADCAST_KEYS = 500_000
SAMPLE_ROWS = 4_096
COMMON = 65_536
PARITIES = 1_024
WORK = 3_000.0  # checks of candidates an entry and word that one_of_each's search of fingerprints may cost, rows included
SHARED = 3  # hashes of their prefixes that two similar sets have in common at least


def fingerprint(text: str | None, shingle: int, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """One 64-bit fingerprint for each seed, as signed integers."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return [0] * len(seeds)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    n = max(1, len(starts) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[shingle - 1 :].tolist() if len(ends) >= shingle else [len(joined)]))
    out = []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 50_000):
            part = spans[at : at + 50_000]
            h = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in part), np.uint64, len(part))
            ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > n).view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """doc_id and fingerprint words f0, f1, ... of each row."""
    names = [f"f{k}" for k in range(len(seeds))]
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seeds) for x in batch["text"]], np.int64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(found[:, k]) for k in range(len(seeds)))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def bit_counts(entries: DataFrame, words: int = 1) -> tuple[int, list[np.ndarray]]:
    """Number of entries, and for each word how many have both bit i and bit j, over all entries."""

    def count(batches):
        total = np.zeros((words, 64, 64))
        for batch in batches:
            for k in range(words):
                bits = np.unpackbits(batch[f"f{k}"].to_numpy().view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
                for at in range(0, len(bits), 1 << 20):
                    total[k] += bits[at : at + (1 << 20)].T @ bits[at : at + (1 << 20)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096 * words, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    cells = entries.select(*[f"f{k}" for k in range(words)]).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096 * words)
    for cell, n in cells:
        both[cell] = n
    return entries.count(), list(both.reshape(words, 64, 64))


def parts_of(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size, each grown by the bit most correlated with those it has."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, out = set(range(64)), []
    for k in range(m):
        size = 64 * (k + 1) // m - 64 * k // m
        group = [max(free, key=lambda b: (related[b, list(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (related[b, group].sum(), -b)))
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def plan(both: np.ndarray, n: int, distance: int, work: float = math.inf) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part: the cheapest allocation over two to eight parts.

    With ``work`` it is that of the largest distance up to the given one whose cost is at most so many checks an entry: then pairs within the given distance may not meet.
    """
    for d in range(distance, -1, -1):
        cost, parts = _cheapest(both, n, d)
        if cost <= work * max(n, 1):
            break
    return parts


def _cheapest(both: np.ndarray, n: int, distance: int) -> tuple[float, list[tuple[list[int], int]]]:
    n = max(n, 1)  # costs of an empty table would all be equal
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, 9):
        parts = parts_of(both, n, m)
        costs = []
        for bits in parts:
            chance = np.ones(1)  # of r differing bits between two entries, r = 0, 1, ...
            for b in bits:
                chance = np.convolve(chance, [1 - differ[b], differ[b]])
            within = np.cumsum(chance)
            balls = np.cumsum([math.comb(len(bits), r) for r in range(len(bits) + 1)])
            costs.append([0.0, *(n * ROW_COST * (1 + (balls[t] - 1) / 2) + float(n) * n * within[t] for t in range(min(distance, len(bits)) + 1))])
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:  # by what is spent of distance + 1
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (total, chosen) in table.items():
                for t, c in enumerate(cost):
                    if spent + t <= distance + 1 and total + c < step.get(spent + t, (math.inf,))[0]:
                        step[spent + t] = (total + c, [*chosen, t - 1])
            table = step
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            best = (table[distance + 1][0], list(zip(parts, table[distance + 1][1])))
    return best[0], [(bits, t) for bits, t in best[1] if t >= 0]


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a minimum spanning forest; of equal weights the first counts as less."""
    if not len(a):
        return np.empty(0, np.int64)
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.argsort(weight, kind="stable")
    x, y = ends[: len(a)][order], ends[len(a) :][order]
    label, place, taken = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        cross = label[x] != label[y]
        x, y, place = x[cross], y[cross], place[cross]
        if not len(x):
            return np.sort(order[np.concatenate(taken)]) if taken else np.empty(0, np.int64)
        # Each component takes its least edge; x and y are in order of weight.
        p, q = label[x], label[y]
        best = np.full(len(nodes), len(x))
        np.minimum.at(best, p, np.arange(len(x)))
        np.minimum.at(best, q, np.arange(len(x)))
        mine = np.flatnonzero(best < len(x))
        edge = best[mine]
        taken.append(place[np.unique(edge)])
        parent = np.arange(len(nodes))
        parent[mine] = np.where(p[edge] == mine, q[edge], p[edge])
        mutual = mine[(parent[parent[mine]] == mine) & (mine < parent[mine])]
        parent[mutual] = mutual
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


class Links:
    """Verified links of a chunk, cut down to a minimum spanning forest as they grow."""

    def __init__(self, prints: np.ndarray, nodes: np.ndarray, distance: int, total: int):
        self.prints, self.nodes, self.distance, self.total = prints, nodes, distance, total
        self.held: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        self.size = 0

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs of rows link, and how many bits differ; i and j broadcast."""
        bits = np.bitwise_count(self.prints[i] ^ self.prints[j])
        far = bits.sum(-1, dtype=np.int64)
        return (bits.min(-1) <= self.distance) & (far <= self.total) & (self.nodes[i] != self.nodes[j]), far

    def add(self, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        self.held.append((i, j, far))
        self.size += len(i)
        if self.size > 4 * SLICE:
            self.reduced()

    def reduced(self) -> tuple[np.ndarray, np.ndarray]:
        i, j, far = (np.concatenate(x) for x in zip(*self.held))
        good = forest(self.nodes[i], self.nodes[j], far)
        self.held, self.size = [(i[good], j[good], far[good])], len(good)
        return self.nodes[i[good]], self.nodes[j[good]]

    def pivots(self, rows: np.ndarray, index: np.ndarray) -> None:
        """The links of a hot value: ``rows`` with each other where one at least is an index row."""
        ones = np.unpackbits(self.prints[rows].view(np.uint8).reshape(len(rows), -1), axis=1).mean(0) > 0.5
        middle = np.packbits(ones).view(np.uint64)
        rows = rows[np.argsort(np.bitwise_count(self.prints[rows] ^ middle).sum(1, dtype=np.int64), kind="stable")]
        index = index[rows]
        label, open_ = np.arange(len(rows)), np.ones(len(rows), bool)
        for _ in range(PIVOTS):
            left = np.flatnonzero(open_)
            if not len(left):
                break
            at = left[0]
            open_[at] = False
            good, far = self.near(rows[at], rows)
            good = np.flatnonzero(good & (index | index[at]))
            open_[good] = False
            self.add(np.full(len(good), rows[at]), rows[good], far[good])
            joined = np.isin(label, label[np.append(good, at)])
            label[joined] = label[joined].min()
        names, count = np.unique(label, return_counts=True)
        rest = np.flatnonzero(label != names[count.argmax()])
        step = max(1, SLICE // len(rows))
        for at in range(0, len(rest), step):
            part = rest[at : at + step]
            good, far = self.near(rows[part][:, None], rows[None, :])
            i, j = np.nonzero(good & (index[None, :] | index[part][:, None]) & (label[None, :] != label[part][:, None]))
            self.add(rows[part[i]], rows[j], far[i, j])


def _match(table: pa.Table, words: int, distance: int, total: int) -> pa.Table:
    """The forest of one chunk's links."""
    probe = table["probe"].to_pylist()
    order = [k for kind in (False, True) for k, x in enumerate(probe) if x == kind]
    column = lambda name, dtype: np.frombuffer(b"".join(table[name][k].as_py() for k in order), dtype)
    keys, prints, nodes = column("keys", np.uint64), column("prints", np.uint64).reshape(-1, words), column("nodes", np.int64)
    n_index = sum(len(table["keys"][k].as_py()) for k in order if not probe[k]) // 8
    by_key = np.argsort(keys[:n_index], kind="stable")
    place = np.concatenate((by_key, np.arange(n_index, len(keys))))
    keys, links = keys[place], Links(prints[place], nodes[place], distance, total)
    own = keys[:n_index]
    low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
    low[:n_index] = np.arange(1, n_index + 1)  # of two index rows the first meets the second
    count = high - low
    starts = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1))) if n_index else np.empty(0, np.int64)
    group = np.where(high > 0, np.searchsorted(starts, high, "left") - 1, -1)
    group[count == 0] = -1
    weight = np.bincount(group[group >= 0], count[group >= 0], minlength=len(starts))
    hot = np.flatnonzero(weight > HOT_PAIRS)
    if len(hot):
        index = np.arange(len(keys)) < n_index
        for g in hot:
            links.pivots(np.flatnonzero(keys == own[starts[g]]), index)
        count = np.where(np.isin(group, hot), 0, count)
    rows = np.flatnonzero(count)
    ends = np.cumsum(count[rows])
    for at in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        pair = np.arange(at, min(int(ends[-1]), at + SLICE))
        which = np.searchsorted(ends, pair, "right")
        i = rows[which]
        j = low[i] + pair - (ends[which] - count[i])
        good, far = links.near(i, j)
        links.add(i[good], j[good], far[good])
    u, v = links.reduced()
    return pa.table({"u": u, "v": v}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def links(entries: DataFrame, words: int, distance: int, total: int, chunk_rows: int = CHUNK_ROWS, work: float = math.inf) -> DataFrame:
    """(u, v) links that span all links within each chunk; entries: node, f0, f1, ... of which any word finds a pair.

    Two entries link if a word differs in at most ``distance`` bits and all words in at most ``total``. With ``work`` (see ``plan``)
    the search costs no more an entry however many there are, and of these links some are left out.
    """
    n, both = bit_counts(entries, words)
    plans = [(k, bits, t) for k in range(words) for bits, t in plan(both[k], n, distance, work)]
    masks = [np.uint64(sum(1 << b for b in bits)) for _, bits, _ in plans]
    flips = [np.array([sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(bits, r)], np.uint64) for _, bits, t in plans]
    width = 16 + 8 * words
    chunk_bits = max(LEAST_CHUNKS_BITS, math.ceil(math.log2(max(1, n * sum(1 + len(f) / 2 for f in flips) * width / CHUNK_BYTES))))
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("probe", pa.bool_()), ("keys", pa.binary()), ("prints", pa.binary()), ("nodes", pa.binary())])

    def dealt(rows: pa.RecordBatch, probe: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each value that the rows are sent to, in order, and the row's place."""
        hashed, source = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for number, ((k, _, _), mask, flip) in enumerate(zip(plans, masks, flips)):
            own = rows[f"f{k}"].to_numpy().view(np.uint64) & mask
            if probe:
                values = own[:, None] ^ flip[None, :]
                at, column = np.nonzero(values > own[:, None])
                values = values[at, column]
            else:
                values, at = own, np.arange(len(own))
            hashed.append(mix(values + np.uint64(0x9E3779B97F4A7C15 * (number + 1) % (1 << 64))))
            source.append(at)
        h, at = np.concatenate(hashed), np.concatenate(source)
        order = np.argsort(h)
        return h[order], at[order]

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for probe in (False, True):
                    found = np.bincount((dealt(batch.slice(at, 4096), probe)[0] >> np.uint64(64 - chunk_bits)).astype(np.int64), minlength=len(total))
                    found[: len(total)] += total
                    total = found
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["chunk", "n"])

    # At least a chunk's average: what this collects is bounded by all rows sent over the limit.
    many = entries.mapInArrow(count, "chunk long, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where(F.col("n") > chunk_rows).collect()
    blocks = {chunk: 2 * math.ceil(size / chunk_rows) for chunk, size in many}

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                nodes = rows["node"].to_numpy()
                prints = np.column_stack([rows[f"f{k}"].to_numpy().view(np.uint64) for k in range(words)])
                for probe in (False, True):
                    h, source = dealt(rows, probe)
                    chunk = (h >> np.uint64(64 - chunk_bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
                    out = [[], [], [], [], [], []]

                    def put(chunk: int, block: int, h: np.ndarray, s: np.ndarray) -> None:
                        for column, x in zip(out, (chunk, block, probe, h.tobytes(), prints[s].tobytes(), nodes[s].tobytes())):
                            column.append(x)

                    for i, j in zip(cuts[:-1], cuts[1:]):
                        key, part, s = int(chunk[i]), h[i:j], source[i:j]
                        if key not in blocks:
                            put(key, 0, part, s)
                            continue
                        b = blocks[key]
                        piece = (mix(nodes[s].view(np.uint64)) % np.uint64(b)).astype(np.int64)
                        for x, y in combinations(range(b), 2):  # a task for each two blocks
                            mine = (piece == x) | (piece == y)
                            if mine.any():
                                put(key, x * b + y, part[mine], s[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    def match(table):
        return _match(table, words, distance, total)

    return entries.mapInArrow(deal, "chunk long, block int, probe boolean, keys binary, prints binary, nodes binary").groupBy("chunk", "block").applyInArrow(match, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 10, seeds: tuple[int, ...] = (42,), total: int | None = None) -> DataFrame:
    """doc_id, f0, f1, ... and component_id (the smallest doc_id reachable) of each row.

    Two fingerprints link when one of their words differs in at most ``distance`` bits and all
    words together in at most ``total`` (default: ``distance`` for each word). With five-word
    shingles a similarity (Jaccard) of 0.8 differs in 15 % of the bits on average.
    """
    names = [f"f{k}" for k in range(len(seeds))]
    total = distance * len(seeds) if total is None else total
    rows = cut(fingerprints(docs, shingle, seeds))
    entries = cut(rows.groupBy(*names).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    found = links(entries.where("node is not null"), len(seeds), distance, total)
    same = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").join(rows, "doc_id").join(entries.where("node is not null"), names)
    roots = components(found.unionAll(same.where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))))
    classes = entries.join(roots, "node", "left").select(*names, "copies", F.coalesce("root", "node").alias("component_id"))
    return _with_classes(rows, classes, names).select("doc_id", *names, "component_id")


def _with_classes(rows: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    """rows joined with their class. Classes of more than HOT_ROWS copies, less than one for each HOT_ROWS rows, go to every task."""
    hot = F.broadcast(classes.where(F.col("copies") > HOT_ROWS))
    return rows.join(hot, names).unionByName(rows.join(hot, names, "left_anti").join(classes.where(F.col("copies") <= HOT_ROWS), names))


# Groups by similarity


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; ASCII capitals are folded; fewer words are one shingle."""
    for at, to in slices(texts):
        data, offsets = text_buffers(texts.slice(at, to - at))
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        starts, ends, first = word_bounds(data, offsets)
        h = word_hashes(data, starts, ends)
        run = np.zeros(len(h), np.uint64)
        for k in range(min(shingle, len(h))):
            run[: len(h) - k] = mix(run[: len(h) - k] * np.uint64(0x9FB21C651E98DF25) + h[k:])
        for i, j in zip(first[:-1], first[1:]):
            if i == j:
                yield np.empty(0, np.uint64)
            elif j - i < shingle:
                whole = np.uint64(0)
                for x in h[i:j]:
                    whole = mix(np.array([whole]) * np.uint64(0x9FB21C651E98DF25) + x)[0]
                yield np.array([whole])
            else:
                yield np.unique(run[i : j - shingle + 1])


def sketch(hashes: np.ndarray, words: int) -> list[int]:
    """The SimHash words of a set of hashes, and a hash of the whole set."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 50_000):
            salted = mix(hashes[at : at + 50_000] + np.uint64(0xD1B54A32D192ED03 * (k + 1) % (1 << 64)))
            ones += np.unpackbits(salted.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0]) if len(hashes) else 0)
    return [*out, int(mix(hashes).sum(dtype=np.uint64).view(np.int64)) if len(hashes) else 0]


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that more than two of some SAMPLE_ROWS texts hold, sorted, and in how many; the COMMON most frequent at most.

    Only the order of prefixes comes from the sample, and which pairs share one doesn't depend on the order.
    """
    n = docs.count()

    def distinct(batches):
        for batch in batches:
            for x in shingle_sets(batch["text"], shingle):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["h"])

    sample = docs.select("text").sample(fraction=min(1.0, SAMPLE_ROWS / max(n, 1)), seed=7)
    rows = sample.mapInArrow(distinct, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, seen = np.array([r.h for r in rows] or [0], np.int64).view(np.uint64), np.array([r.n for r in rows] or [0], np.int64)
    order = np.argsort(h)
    return h[order], seen[order]


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The hashes of a set that come first, rare ones before common ones: two sets that are similar share SHARED of them at least, or all they have in common.

    Of n hashes a similar set has all but n - similarity * n at most, so of SHARED more of them it has SHARED.
    """
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    order = np.argsort(np.where(common[at] == hashes, seen[at], 0), kind="stable")
    return hashes[order[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + SHARED]]


def parities(hashes: np.ndarray) -> bytes:
    """For each class of hashes by their low bits whether a set has an odd number of it; PARITIES classes, or the power of two from twice the set's size on.

    Two sets differ in as many hashes at least as their parities do; more classes fold to fewer by halves.
    """
    n = max(PARITIES, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((mix(hashes) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).tobytes()


def parities_fit(pairs: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose parities don't rule the similarity out: a pair that has it is never dropped. entries: node, size, odd."""
    most = (1 - similarity) / (1 + similarity)  # of both sizes, in hashes that one set alone has

    def fit(batches):
        for batch in batches:
            good = []
            for a, b, n in zip(batch["a"], batch["b"], batch["n"].to_pylist()):
                x, y = sorted((np.frombuffer(z.as_py(), np.uint64) for z in (a, b)), key=len)
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                good.append(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= most * n + 1e-6)
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    side = lambda node, odd, size: entries.select(F.col("node").alias(node), F.col("odd").alias(odd), F.col("size").alias(size))
    both = pairs.join(side("u", "a", "m"), "u").join(side("v", "b", "n"), "v")
    return both.select("u", "v", "a", "b", (F.col("m") + F.col("n")).alias("n")).mapInArrow(fit, "u long, v long")


def _crossing(table: pa.Table, similarity: float) -> pa.Table:
    """Pairs of one chunk that share a hash of their prefixes, have different labels, and can be similar by what is left of both sets from there.

    n: how many such hashes they share in this chunk; least: how many they share in all chunks if they are similar.
    """
    column = lambda name, dtype: np.frombuffer(b"".join(x.as_py() for x in table[name]), dtype)
    keys, nodes, labels = column("keys", np.uint64), column("nodes", np.int64), column("labels", np.int64)
    labels = labels ^ nodes  # as they are sent
    sizes, left = column("sizes", np.int32).astype(np.int64), column("rest", np.int32).astype(np.int64)
    order = np.lexsort((labels, keys))
    keys, nodes, labels, sizes, left = (x[order] for x in (keys, nodes, labels, sizes, left))
    run = np.flatnonzero(np.append((np.diff(keys) != 0) | (np.diff(labels) != 0), True)) + 1
    start = run[np.searchsorted(run, np.arange(len(keys)), "right")]  # the next label of the same hash, or the next hash
    count = np.searchsorted(keys, keys, "right") - start
    rows = np.flatnonzero(count)
    ends = np.cumsum(count[rows])
    held, size = [np.empty((4, 0), np.int64)], 0

    def distinct() -> np.ndarray:
        pairs = np.concatenate(held, axis=1)
        pairs = pairs[:, np.lexsort(pairs[:2])]
        first = np.flatnonzero(np.append(True, (np.diff(pairs[:2]) != 0).any(0))) if pairs.shape[1] else np.empty(0, np.int64)
        return np.vstack((pairs[:2, first], np.add.reduceat(pairs[2], first) if len(first) else pairs[2], pairs[3, first]))

    for at in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        pair = np.arange(at, min(int(ends[-1]), at + SLICE))
        which = np.searchsorted(ends, pair, "right")
        i = rows[which]
        j = start[i] + pair - (ends[which] - count[i])
        # The k-th hash that they share has k - 1 before it, and only the first SHARED must be counted.
        good = (np.minimum(left[i], left[j]) + SHARED - 1) * (1 + similarity) >= similarity * (sizes[i] + sizes[j]) - 1e-6
        i, j = i[good], j[good]
        least = np.minimum(SHARED, np.ceil(similarity * np.maximum(sizes[i], sizes[j]) - 1e-6).astype(np.int64))
        i, j = nodes[i], nodes[j]
        held.append(np.stack((np.minimum(i, j), np.maximum(i, j), np.ones_like(i), least)))
        size += len(i)
        if size > 4 * SLICE:
            held = [distinct()]
            size = held[0].shape[1] // 2  # so that each time at least as many are new
    u, v, n, least = distinct()
    return pa.table({"u": u, "v": v, "n": n, "least": least}, pa.schema([(x, pa.int64()) for x in ("u", "v", "n", "least")]))


def crossing(entries: DataFrame, similarity: float, chunk_rows: int = CHUNK_ROWS // 2) -> DataFrame:
    """Distinct (u, v): all pairs of entries of different labels that may have the similarity. entries: node, label, size, prefix (packed hashes).

    Rows meet by the hashes of their prefixes, packed by chunk (a hash range); chunks above ``chunk_rows`` are cut into
    blocks of entries, a task for each two blocks. A pair that shares fewer than SHARED hashes is dropped: those that share one
    by chance grow with the square of the entries. In a chunk cut into blocks two entries of one block meet in each of its tasks, so they may be counted more than once.
    """
    n = entries.agg(F.sum(F.length("prefix"))).first()[0] or 0
    chunk_bits = max(LEAST_CHUNKS_BITS, math.ceil(math.log2(max(1, 4 * n / CHUNK_BYTES))))
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), *((x, pa.binary()) for x in ("keys", "nodes", "labels", "sizes", "rest"))])

    def dealt(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Chunk, hash, place of the row and hashes of the row from there on, in order of chunks, of some rows at a time."""
        size = np.array([len(x) // 8 for x in batch["prefix"].to_pylist()], np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            keys = np.frombuffer(b"".join(batch["prefix"].slice(at, to - at).to_pylist()), np.uint64)
            source = np.repeat(np.arange(at, to), size[at:to])
            place = np.arange(len(keys)) - (ends - size)[source] + (ends[at] - size[at])
            left = batch["size"].to_numpy()[source] - place
            chunk = (mix(keys + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - chunk_bits)).astype(np.int64)
            order = np.argsort(chunk, kind="stable")
            yield chunk[order], keys[order], source[order], left[order].astype(np.int32)
            at = to

    def count(batches):
        for batch in batches:
            for chunk, *_ in dealt(batch):
                held, n = np.unique(chunk, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], names=["chunk", "n"])

    many = entries.mapInArrow(count, "chunk long, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where(F.col("n") > chunk_rows).collect()
    blocks = {chunk: 2 * math.ceil(size / chunk_rows) for chunk, size in many}

    def deal(batches):
        for batch in batches:
            nodes, labels, sizes = batch["node"].to_numpy(), batch["label"].to_numpy(), batch["size"].to_numpy()
            for chunk, keys, source, left in dealt(batch):
                cuts = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
                out = [[] for _ in schema]

                def put(key: int, block: int, k: np.ndarray) -> None:
                    s = source[k]
                    for column, x in zip(out, (key, block, keys[k].tobytes(), nodes[s].tobytes(), (labels[s] ^ nodes[s]).tobytes(), sizes[s].tobytes(), left[k].tobytes())):
                        column.append(x)

                for i, j in zip(cuts[:-1], cuts[1:]):
                    key, own = int(chunk[i]), np.arange(i, j)
                    b = blocks.get(key)
                    if b is None:
                        put(key, 0, own)
                        continue
                    piece = (mix(nodes[source[own]].view(np.uint64)) % np.uint64(b)).astype(np.int64)
                    for x, y in combinations(range(b), 2):
                        mine = own[(piece == x) | (piece == y)]
                        if len(mine):
                            put(key, x * b + y, mine)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    def match(table):
        return _crossing(table, similarity)

    names = "chunk long, block int, keys binary, nodes binary, labels binary, sizes binary, rest binary"
    met = entries.select("node", "label", "size", "prefix").mapInArrow(deal, names).groupBy("chunk", "block").applyInArrow(match, "u long, v long, n long, least long")
    return met.groupBy("u", "v").agg(F.sum("n").alias("n"), F.first("least").alias("least")).where("n >= least").select("u", "v")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 2, distance: int = 10, slack: float = 0.06) -> DataFrame:
    """The rows of docs that stay: of each group linked by ``similarity`` of shingles the one with the smallest doc_id (then text hash).

    Most links come from ``words`` independent fingerprints, each searched within ``distance`` bits:
    at similarity 0.8 and ten bits one word finds 61 % of the pairs, two find 85 %, at 0.85 97 %; in tables where that would cost more
    than WORK an entry fewer bits are searched. Candidates
    that differ in more bits of all words than ``similarity`` does on average and ``slack`` of them go;
    the Jaccard similarity of the others, as far as they are in a chunk's spanning forest of
    nearest pairs, is computed from all their shingles. What these leave apart is then searched exactly: any two
    similar sets share SHARED hashes of their prefixes, so all pairs of different groups that do and that parities of their hashes don't rule out are compared; no link is left out.
    """
    names = [f"f{k}" for k in range(words)]
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), *((x, pa.int64()) for x in (*names, "content")), ("size", pa.int32()), ("prefix", pa.binary()), ("odd", pa.binary())])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("string").alias("text"))
    common, seen = common_shingles(keyed, shingle)

    def sketched(batches):
        for batch in batches:
            found, sizes, first, odd = [], [], [], []
            for x in shingle_sets(batch["text"], shingle):
                found.append(sketch(x, words))
                sizes.append(len(x))
                first.append(prefix(x, similarity, common, seen).tobytes())
                odd.append(parities(x))
            prints = np.array(found, np.int64).reshape(-1, words + 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["copy"], *(pa.array(prints[:, k]) for k in range(words + 1)), pa.array(sizes, pa.int32()), pa.array(first, pa.binary()), pa.array(odd, pa.binary())], schema=schema)

    rows = cut(keyed.mapInArrow(sketched, f"doc_id long, copy long, {', '.join(f'{x} long' for x in names)}, content long, size int, prefix binary, odd binary"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    entries = cut(rows.groupBy(*names, "content").agg(F.min(key).alias("first"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd")).withColumn("node", F.xxhash64(*names, "content")))
    cosine = 2 * similarity / (1 + similarity)
    total = round(64 * words * (math.acos(cosine) / math.pi + slack))
    pairs = cut(links(entries, words, distance, total, work=WORK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    packed = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def sets(batches):
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch["text"], shingle)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.binary())], schema=packed)

    def similar(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch["a"], batch["b"]):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (a, b))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar."""
        wanted = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct().join(entries.select("node", "first"), "node").select("node", "first.doc_id", "first.copy")
        named = _looked_up(keyed, wanted, "inner").dropDuplicates(["node"]).select("node", "text")
        held = cut(named.mapInArrow(sets, "node long, hashes binary"))
        both = pairs.join(held.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
        return both.select("u", "v", "a", "b").mapInArrow(similar, "u long, v long")

    roots = components(confirmed(pairs))
    apart = crossing(entries.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "prefix"), similarity)
    apart = cut(parities_fit(apart, entries, similarity))
    if not apart.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(confirmed(apart)))
    first = entries.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = first.select("first.doc_id", "first.copy")
    held_keys = rows.groupBy("doc_id", "copy").agg(F.count("*").alias("n"))
    mark = held_keys.join(kept.withColumn("kept", F.lit(True)), held_keys["doc_id"].eqNullSafe(kept["doc_id"]) & (held_keys["copy"] == kept["copy"]), "left").select(held_keys["doc_id"], held_keys["copy"], "n", "kept")
    odd = cut(mark.where("kept is null or n > 1"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.struct(*docs.columns).alias("row"))
    alone = _looked_up(whole, odd.select("doc_id", "copy"), "left_anti").select("row.*")
    again = _looked_up(whole, odd.where("kept").select("doc_id", "copy"), "left_semi")
    one = again.groupBy("doc_id", "copy").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return alone.unionByName(one.select("row.*"))


def _looked_up(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows joined with keys by doc_id, null or not, and copy; up to BROADCAST_KEYS keys, counted here, go to every task, more are shuffled with the rows."""
    side = keys.withColumnsRenamed({"doc_id": "_id", "copy": "_copy"})
    side = F.broadcast(side) if keys.count() <= BROADCAST_KEYS else side
    return rows.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), how)
