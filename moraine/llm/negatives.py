"""Hard negatives inside score windows, by product quantisation with stored residual norms.

1. Codebooks of ``CENTROIDS`` points for every ``SPAN`` components, by k-means on a sample of up to
   ``sample`` rows in the order of a hash. Every row is coded by all of them, and the norm of what each
   code leaves is stored beside it. The sample affects time only.
2. For an anchor a, a row x, its codes c and residuals r, <a, x> is <a, c> + <a, r>: a lookup table gives the
   first, and the second is at most the sum of |a_s| |r_s| over the parts s. So each score is known within
   a bound before the vector is read.
3. Positives: of the rows of the anchor's label in a block those whose upper bound reaches the kth largest lower bound
   are scored exactly.
4. Negatives: a row is left out of a positive's window if its bounds lie outside the window, or if enough
   rows are surely inside and score surely more. The rest are scored exactly in integers, which completes each window.

Blocks of rows and chunks of anchors are of bounded size; a task holds one of each and returns at most k rows
a window, so a label or a vector that many rows share is spread like any other. All anchors meet
all blocks: the work is anchors times rows, over codes.

Nulls, ties and odd inputs: rows without id or label, and vectors that are null or hold a null or
non-finite component, take no part; shorter vectors are filled up with zeros. Equal scores go to the smaller
id. Rows that repeat an id are candidates each, but never for that id's anchor, which is run once, for the row with
the smallest label and vector. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .topk import matrix, norms, products

SPAN, CENTROIDS, ROUNDS = 2, 256, 6
CELLS = 2_000_000
DENSE = 0.1


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and integer components of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where("vec_id is not null and label is not null and x is not null").where(fine).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def parts(points: np.ndarray) -> np.ndarray:
    """Points cut into spans, the last filled with zeros: rows x parts x SPAN."""
    width = points.shape[1]
    return np.pad(points.astype(np.float64), ((0, 0), (0, -width % SPAN))).reshape(len(points), -1, SPAN)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


def codebooks(sample: np.ndarray) -> np.ndarray:
    """parts x CENTROIDS x SPAN, each by a few rounds of k-means from the first distinct points."""
    out = []
    for points in parts(sample).transpose(1, 0, 2):
        _, first = np.unique(points, axis=0, return_index=True)
        centres = points[np.sort(first)[:CENTROIDS]]
        for _ in range(ROUNDS):
            own = nearest(points, centres)
            count = np.bincount(own, minlength=len(centres))
            total = np.stack([np.bincount(own, points[:, k], len(centres)) for k in range(SPAN)], 1)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        out.append(np.concatenate((centres, np.repeat(centres[-1:], CENTROIDS - len(centres), 0))))
    return np.array(out)


def coded(points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row, and the norm of what each code leaves, not below the true one."""
    cut_up = parts(points)
    codes = np.empty(cut_up.shape[:2], np.uint8)
    left = np.empty(cut_up.shape[:2])
    for s, centres in enumerate(books):
        codes[:, s] = nearest(cut_up[:, s], centres)
        left[:, s] = norms(cut_up[:, s] - centres[codes[:, s]])
    return codes, np.nextafter(left.astype(np.float32), np.float32(np.inf))


class Rows:
    """A block of rows with codes and residual norms."""

    def __init__(self, table: pa.Table, width: int):
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.points = matrix(table["v"], width)
        m = -(-width // SPAN)
        self.codes = np.frombuffer(b"".join(x.as_py() for x in table["codes"]), np.uint8).reshape(-1, m)
        self.left = np.frombuffer(b"".join(x.as_py() for x in table["left"]), np.float32).reshape(-1, m)
        self.size = norms(self.points) + norms(self.left)

    def taken(self, at: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        for name in ("ids", "labels", "points", "codes", "left", "size"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def bounds(self, anchors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No score of an anchor with a row is below the first or above the second; anchors x rows."""
        cut_up = parts(anchors)
        score = np.zeros((len(self.ids), len(anchors)), np.float32)
        for s, centres in enumerate(books):
            score += (centres @ cut_up[:, s].T).astype(np.float32)[self.codes[:, s]]
        m = self.codes.shape[1]
        away = self.left @ np.sqrt((cut_up**2).sum(2)).T.astype(np.float32)
        # What rounding to 24 bits can add up to, in the table and in both sums.
        away = away * (1 + (m + 4) * 2e-7) + (m + 4) * 4e-7 * self.size[:, None] * norms(anchors)[None, :] + 1e-3
        return (score - away).T, (score + away).T


def exact(anchors: np.ndarray, points: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of anchors[i] and points[j]: as one product of matrices if most pairs are asked for."""
    if len(i) > DENSE * len(anchors) * len(points):
        return products(anchors, points)[i, j]
    a, b = (x if x.dtype == y.dtype else x.astype(np.int64) for x, y in ((anchors, points), (points, anchors)))
    step = max(1, CELLS // max(1, a.shape[1]))
    return np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]).astype(np.int64) for k in range(0, len(i), step))])


def first_k(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    sorted_ = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]


def kth(values: np.ndarray, good: np.ndarray, k: int) -> np.ndarray:
    """The kth largest good value of each row, or minus infinity."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(np.where(good, -values, np.inf), k - 1, 1)[:, k - 1]


def positives_of(rows: Rows, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, books: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (its place), score and id of each anchor's best k other rows of its label in the block."""
    out = [(np.empty(0, np.int64),) * 3]
    for label in np.unique(labels):
        mine, own = np.flatnonzero(labels == label), rows.taken(np.flatnonzero(rows.labels == label))
        step = max(1, CELLS // max(1, len(own.ids)))
        for at in range(0, len(mine) if len(own.ids) else 0, step):
            some = mine[at : at + step]
            other = own.ids[None, :] != ids[some][:, None]
            low, high = own.bounds(anchors[some], books)
            i, j = np.nonzero(other & (high >= kth(low, other, k)[:, None]))
            score = exact(anchors[some], own.points, i, j)
            good = first_k(i, score, own.ids[j], k)
            out.append((some[i[good]], score[good], own.ids[j[good]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def negatives_of(rows: Rows, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, windows: np.ndarray, books: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Anchor (its place), window, score and id of the best k rows of another label in each window (anchors x windows x (low, high), empty if low > high)."""
    out = [(np.empty(0, np.int64),) * 4]
    step = max(1, CELLS // max(1, len(rows.ids)))
    for at in range(0, len(ids), step):
        some = np.arange(at, min(len(ids), at + step))
        other = (rows.labels[None, :] != labels[some][:, None]) & (rows.ids[None, :] != ids[some][:, None])
        low, high = rows.bounds(anchors[some], books)
        wanted = np.zeros(other.shape, bool)
        for w in range(windows.shape[1]):
            least, most = windows[some, w, 0][:, None], windows[some, w, 1][:, None]
            sure = other & (low >= least) & (high <= most)
            wanted |= other & (high >= least) & (low <= most) & (high >= kth(low, sure, k)[:, None]) & (least <= most)
        i, j = np.nonzero(wanted)
        score = exact(anchors[some], rows.points, i, j)
        for w in range(windows.shape[1]):
            inside = np.flatnonzero((score >= windows[some, w, 0][i]) & (score <= windows[some, w, 1][i]))
            good = inside[first_k(i[inside], score[inside], rows.ids[j[inside]], k)]
            out.append((some[i[good]], np.full(len(good), w), score[good], rows.ids[j[good]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, sample: int = 4096, chunk_anchors: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of another
    label whose score is between ``low`` and ``high`` percent of the positive's.
    """
    rows = quantised(vectors, scale)
    n, asked, width = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    block_rows = min(65_536, max(4096, n // 64))
    blocks, chunks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / chunk_anchors))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(sample).select("v").collect()
    books = codebooks(matrix(pa.array([r[0] for r in drawn], pa.list_(pa.int64())), width)) if drawn else np.zeros((1, CENTROIDS, SPAN))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes, left = coded(matrix(part["v"], width), books)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], part["v"], pa.array([x.tobytes() for x in codes]), pa.array([x.tobytes() for x in left])], names=["vec_id", "label", "v", "codes", "left"])

    index = cut(rows.mapInArrow(encode, "vec_id long, label long, v array<long>, codes binary, left binary"))
    anchors = index.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select(F.col("vec_id").alias("anchor_id"), F.col("a.label").alias("own"), F.col("a.v").alias("point"))

    chunk = F.pmod(F.xxhash64(F.lit(5), "anchor_id"), F.lit(chunks)).cast("int").alias("part")

    def every(many: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)

    block = index.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id", "label", "v"), F.lit(blocks)).cast("int")).select("*", every(chunks, "chunk"))
    key = ["block", "chunk"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in ("anchor_id", "positive_id", "positive_score")})
        ids = right["anchor_id"].to_numpy()
        at, score, found = positives_of(Rows(left, width), ids, right["own"].to_numpy(), matrix(right["point"], width), books, positives)
        return pa.table({"anchor_id": ids[at], "positive_id": found, "positive_score": score})

    sent = anchors.select("*", chunk, every(blocks, "piece"))
    found = block.groupBy(*key).cogroup(sent.groupBy("piece", "part")).applyInArrow(best, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = cut(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))

    def mine(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("anchor_id", "place", "negative_id", "negative_score")
        if not left.num_rows or not right.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        ids = right["anchor_id"].to_numpy()
        windows = np.tile(np.array([1, 0], np.int64), (len(ids), positives, 1))
        for k, scores in enumerate(right["scores"].to_pylist()):
            for s in scores:
                windows[k, s["place"] - 1] = -(-low * s["positive_score"] // 100), high * s["positive_score"] // 100
        at, w, score, other = negatives_of(Rows(left, width), ids, right["own"].to_numpy(), matrix(right["point"], width), windows, books, negatives)
        return pa.table(dict(zip(names, (ids[at], w + 1, other, score))))

    windows = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "positive_score")).alias("scores"))
    sent = anchors.join(windows, "anchor_id").select("*", chunk, every(blocks, "piece"))
    found = block.groupBy(*key).cogroup(sent.groupBy("piece", "part")).applyInArrow(mine, "anchor_id long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: DuckDB: every anchor against every row.
ORACLE = r"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)])::bigint as score
  from rows a, rows b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
found as (
  select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from found where rank <= 10
"""
