"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, so scores are exact.

1. The upper level of the cover tree: ``sample`` rows, chosen by a hash, are walked farthest first
   until their points are no further apart than need be for one centre a ``block_rows`` rows.
   Every row goes to its nearest centre; the exact radius of each part, over all its rows, and
   of the queries in it are aggregated. Parts above ``block_rows`` are dealt further by a hash.
2. A query begins with its kth score among the sample, a bound on what can be in its result.
   For centres q, p and radii r, s no pair below scores more than <q,p> + r|p| + s|q| + rs. A group
   of queries isn't sent to a part where that is below the worst kth score in the group, nor is a
   query where its own bound <q,p> + s|q| is below its own.
3. In a block both sides are indexed by a tree: a node's children are points more than half its
   radius apart that cover all its points within half its radius, and each node knows the exact
   radius of what it holds. Pairs of nodes are visited the most promising first and dropped by the
   same bound against the worst kth score found so far; pairs of leaves are scored at once.

A task holds one block of rows and one chunk of at most ``chunk_queries`` of its queries. The
sample, the centres and a boolean for each pair of centres are all that is sent to every task,
so the size of that is set by ``sample``; it affects time only.

Nulls, ties and odd inputs: vectors that are null or hold a null or non-finite component, and
rows without id, take no part; shorter vectors are filled up with zeros; equal scores go to the
smaller id; rows that repeat an id are candidates each, but none of them for that id's queries,
which are run once, for the row that is smallest as a vector. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128
SLICE = 1024
LOW = -np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where("vec_id is not null and x is not null").where(fine).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of components, filled with zeros to the widest; as floats if all products are exact in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    top = int(np.abs(out).max(initial=0))
    return out.astype(np.float64) if top < 2**31 and width * top * top < 2**53 else out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b."""
    if a.dtype != b.dtype:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return (a @ b.T).astype(np.int64)


def norms(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points.astype(np.float64) ** 2).sum(1))


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of every point to every centre, not below the true ones."""
    a, b = points.astype(np.float64), centres.astype(np.float64)
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0)) + 1e-7 * (norms(a)[:, None] + norms(b)[None, :])


def upper(product: np.ndarray, q: np.ndarray, r: np.ndarray, p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """No pair within r and s of centres with norms q and p and this product scores more."""
    return product + r * p + s * q + r * s + 1e-9 * (q + r) * (p + s) + 1e-6


def spread_out(points: np.ndarray, most: int, reach: float = 0.0, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """At most that many points, each the farthest from those before, until all are within reach; each point's centre and distance."""
    chosen = [first]
    nearest, owner = distances(points, points[[first]])[:, 0], np.zeros(len(points), np.int64)
    while len(chosen) < most and nearest.max() > reach:
        new = int(nearest.argmax())
        d = distances(points, points[[new]])[:, 0]
        if new in chosen:  # only copies of the centres are left
            break
        closer = d < nearest
        owner[closer], nearest[closer] = len(chosen), d[closer]
        chosen.append(new)
    return chosen, owner, nearest


class Tree:
    """A cover tree of points, built from the top: centre, radius, children and rows of each node."""

    def __init__(self, points: np.ndarray):
        self.exact = points
        self.points = points.astype(np.float64)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        todo = [(np.arange(len(points)), 0, -1)] if len(points) else []
        while todo:
            rows, centre, parent = todo.pop()
            radius = float(distances(self.points[rows], self.points[[centre]]).max())
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(radius)
            self.children.append([])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= LEAF:
                continue
            # Points so far from each other that nodes would hold few are better scored at once.
            most = max(2, len(rows) // (LEAF // 4))
            chosen, owner, nearest = spread_out(self.points[rows], most, radius / 2, int(np.flatnonzero(rows == centre)[0]))
            if len(chosen) > 1 and nearest.max() <= radius / 2:
                todo += [(rows[owner == k], int(rows[c]), node) for k, c in enumerate(chosen)]
        self.centres = self.points[self.centre]
        self.norm = norms(self.centres)


class Search:
    """The best k of each query among points given in turn."""

    def __init__(self, ids: np.ndarray, seeds: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.least = seeds.copy()  # no score below can be in the result
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.more: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the queries ``rows`` with the points ``ids``."""
        i, j = np.nonzero((scores >= self.least[rows, None]) & (ids[None, :] != self.ids[rows, None]))
        self.more.append((rows[i], scores[i, j], ids[j]))
        self.waiting += len(i)
        if self.waiting > 8 * self.k * len(self.ids):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the best k so far, which also raises the bounds."""
        query, score, found = (np.concatenate(x) for x in zip(self.held, *self.more))
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        good = place < self.k
        self.held, self.more, self.waiting = (query[good], score[good], found[good]), [], 0
        return self.held


def dual(queries: Tree, points: Tree, ids: np.ndarray, search: Search) -> None:
    """Visit node pairs, the most promising first, and drop those that can't matter."""

    def bounds(q: list[int], p: list[int]) -> np.ndarray:
        product = (queries.centres[q] @ points.centres[p].T).ravel()
        many = [np.repeat(x, len(p)) for x in (queries.norm[q], np.array(queries.radius)[q])]
        return upper(product, *many, *(np.tile(x, len(q)) for x in (points.norm[p], np.array(points.radius)[p])))

    if not queries.centre or not points.centre:
        return
    todo = [(float(bounds([0], [0])[0]), 0, 0)]
    while todo:
        bound, q, p = todo.pop()
        below = queries.rows[q]
        if bound < search.least[below].min():
            continue
        if queries.children[q] and (not points.children[p] or queries.radius[q] >= points.radius[p]):
            pairs = [(c, p) for c in queries.children[q]]
            found = bounds(queries.children[q], [p])
        elif points.children[p]:
            pairs = [(q, c) for c in points.children[p]]
            found = bounds([q], points.children[p])
        else:
            rows = points.rows[p]
            for at in range(0, len(below), SLICE):
                part = below[at : at + SLICE]
                search.offer(part, products(queries.exact[part], points.exact[rows]), ids[rows])
            continue
        todo += [(float(found[k]), *pairs[k]) for k in np.argsort(found, kind="stable")]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, sample: int = 1024, block_rows: int = 8192, chunk_queries: int = 32_768) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other rows."""
    rows = quantised(vectors, scale)
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    chunks = max(1, math.ceil(asked / chunk_queries))
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    seed_ids, seed_rows = np.array([r[0] for r in seeds], np.int64), pa.array([r[1] for r in seeds], pa.list_(pa.int64()))
    seed_width = max((len(r[1]) for r in seeds), default=0)
    centres = spread_out(matrix(seed_rows), max(1, math.ceil(n / block_rows)))[0] if seeds else []
    centre_rows = seed_rows.take(pa.array(centres, pa.int64()))

    def same_width(column: pa.Array, *others: pa.Array) -> list[np.ndarray]:
        width = max(seed_width, int(pa.compute.max(column.value_lengths()).as_py() or 0))
        return [matrix(x, width) for x in (column, *others)]

    placed = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("part", pa.int32()), ("far", pa.float64()), ("seed", pa.int64())])

    def place(seeded: bool):
        """Rows with their part, the distance to its centre, and queries with their kth score among the sample."""

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4 * SLICE):
                    part = batch.slice(at, 4 * SLICE)
                    ids, seed = part["vec_id"].to_numpy(), None
                    points, middle, known = same_width(part["v"], centre_rows, seed_rows)
                    far = distances(points, middle)
                    near = far.argmin(1)
                    if seeded:
                        scores = np.where(ids[:, None] == seed_ids[None, :], LOW, products(points, known))
                        seed = np.partition(scores, -k, 1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), LOW)
                    yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near]), pa.nulls(len(ids), pa.int64()) if seed is None else pa.array(seed)], schema=placed)

        return run

    columns = "vec_id long, v array<long>, part int, far double, seed long"
    dealt = rows.mapInArrow(place(False), columns)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(place(True), columns)
    radius, held = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in dealt.groupBy("part").agg(F.max("far"), F.count("*")).collect():
        radius[r[0]], held[r[0]] = r[1], r[2]
    pieces = np.maximum(1, -(-held // block_rows)).tolist()
    reach, worst = np.zeros(len(centres)), np.full(len(centres), np.inf)
    for r in queries.groupBy("part").agg(F.max("far"), F.min("seed")).collect():
        reach[r[0]], worst[r[0]] = r[1], r[2]
    middle = matrix(centre_rows)
    size = norms(middle)
    # The upper nodes of both trees, pair by pair.
    meets = (upper(middle.astype(np.float64) @ middle.T, size[:, None], reach[:, None], size[None, :], radius[None, :]) >= worst[:, None]) & (held > 0)[None, :] if len(centres) else np.empty((0, 0), bool)

    sent = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("seed", pa.int64()), ("parts", pa.list_(pa.int32()))])

    def route(batches):
        for batch in batches:
            points, middle = same_width(batch["v"], centre_rows)
            own = upper(points.astype(np.float64) @ middle.T, norms(points)[:, None], 0.0, size[None, :], radius[None, :])
            good = (own >= batch["seed"].to_numpy()[:, None]) & meets[batch["part"].to_numpy()]
            ends = np.concatenate(([0], np.cumsum(good.sum(1)))).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(good)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], batch["seed"], parts], schema=sent)

    def salt(many: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), "vec_id"), many).cast("int")

    shared = F.element_at(F.array(*map(F.lit, pieces or [1])), F.col("part") + 1)
    spread = (
        queries.mapInArrow(route, "vec_id long, v array<long>, seed long, parts array<int>")
        .select("vec_id", "v", "seed", F.explode("parts").alias("part"))
        .select("vec_id", "v", "seed", "part", salt(F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), shared - 1)).alias("piece"))
    )
    blocks = dealt.select("vec_id", "v", "part", salt(shared).alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        width = max(pa.compute.max(x["v"].combine_chunks().value_lengths()).as_py() for x in (left, right))
        query_ids = right["vec_id"].to_numpy()
        search = Search(query_ids, right["seed"].to_numpy(), k)
        dual(Tree(matrix(right["v"], width)), Tree(matrix(left["v"], width)), left["vec_id"].to_numpy(), search)
        query, score, found = search.best()
        return pa.table({"query_id": query_ids[query], "vec_id": found, "score": score}, out)

    keys = ("part", "piece", "chunk")
    found = blocks.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(block, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB: every query against every row.
ORACLE = r"""
with rows as (
  select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, p.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.v, p.v)])::bigint as score
  from rows q, rows p where q.vec_id % 100 = 0 and q.vec_id <> p.vec_id)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 10
"""
