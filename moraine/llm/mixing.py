"""Mixing of sources to target weights by nested hash-threshold histograms. DataFrame functions only.

Each document has a 60-bit hash of its id and text. A source that gives ``target`` words takes
every document ``floor(target / size)`` times and once more those whose hash is below a
threshold. Sizes are summed by source and the hash's first 12 bits; the bucket in which the
running sum passes what is needed is the boundary, and only its documents are counted again by
the next 12 bits, and so on until it is one hash. Nothing is sorted but the 4,096 bucket sums
of a source. The boundary's own documents are taken if that comes nearer to the target.

Joins of rows are on source and bucket, or on source and a salt taken from the hash, so that a
source with a third of all rows is spread like the rest.

Nulls, ties and odd inputs: a null text has size 0; sources are taken by code point, null last;
a null doc_id is hashed as an empty one; rows with the same id and text are taken or left
together; sources without words have target 0. An empty table gives an empty result. Columns
other than ``doc_id``, ``text`` and ``source`` are ignored, or kept with the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BITS, LEVELS = 12, 5
SALTS = 64
BROADCAST = 1000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """target of each source (key, position, total): level x weight, at most ``most`` times its total.

    Sources are filled in order of capacity by weight; the first that isn't filled sets the
    level for itself and all after it, which is where resharing of the excess ends.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") - 1).cast("int") % len(weights) + 1).cast("double")
    by_room = Window.orderBy("room", "position").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("weight", weight)
        .withColumn("capacity", F.col("total").cast("double") * most)
        .withColumn("room", F.col("capacity") / F.col("weight"))
        .withColumns({"before": F.coalesce(F.sum("capacity").over(by_room), F.lit(0.0)), "spent": F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)), "budget": F.sum("total").over(everything) * F.lit(share), "weights": F.sum("weight").over(everything)})
        .withColumn("level", (F.col("budget") - F.col("before")) / (F.col("weights") - F.col("spent")))
    )
    level = F.min(F.when(F.col("room") > F.col("level"), F.struct("room", "position", "level"))).over(everything)["level"]
    return filled.withColumn("target", F.least(F.col("capacity"), F.coalesce(F.col("weight") * level, F.col("capacity")))).select("key", "total", "target")


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _hash() -> Column:
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def limits(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """For each source of rows (key, size, hash): total, target, full copies, and the hash below which one more is taken."""
    last = F.when(F.col("key") == "", 1).otherwise(0)  # the null source
    sources = rows.groupBy("key").agg(F.sum("size").alias("total")).withColumn("position", F.row_number().over(Window.orderBy(last, "key")))
    plan = cut(targets(sources, weights, share, most).withColumn("full", F.when(F.col("total") > 0, F.floor(F.col("target") / F.greatest("total", F.lit(1)))).otherwise(0).cast("int")))
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    state = plan.select("key", (F.col("target") - F.col("full") * F.col("total")).alias("need"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("upto"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("hash", shift).alias("bucket")
        if level == 1:
            sums = rows.groupBy("key", bucket).agg(F.sum("size").alias("words"))
        else:
            mine = rows.select("key", F.shiftright("hash", shift + BITS).alias("prefix"), bucket, "size")
            sums = mine.join(state.select("key", "prefix"), ["key", "prefix"], "left_semi").groupBy("key", "bucket").agg(F.sum("size").alias("words"))
        ends = sums.withColumn("end", F.sum("words").over(running)).join(state.select("key", "need", "upto"), "key").withColumn("end", F.col("end") + F.col("upto"))
        boundary = F.min(F.struct("bucket", (F.col("end") - F.col("words")).alias("upto"), "need", "end")).alias("b")
        state = cut(ends.where("end > need").groupBy("key").agg(boundary).select("key", "b.need", F.col("b.bucket").alias("prefix"), "b.upto", "b.end"))
    nearer = F.when(F.col("need") - F.col("upto") > F.col("end") - F.col("need"), 1).otherwise(0)
    return cut(plan.join(state, "key", "left").select("key", "total", "target", "full", (F.col("prefix") + nearer).alias("below")))


def with_limits(rows: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """rows (key, hash and more) with their source's limits and copies.

    Up to BROADCAST sources, counted here, their limits go to every task; more are joined under
    a salt from the hash, so that no source is dealt to one task.
    """
    copies = (F.col("full") + F.when((F.col("hash") < F.col("below")) & (F.col("full") < most), 1).otherwise(0)).cast("int")
    if found.count() <= BROADCAST:
        return rows.join(F.broadcast(found), "key").withColumn("copies", copies)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.col("hash") % SALTS).cast("int")).join(salted, ["key", "salt"]).withColumn("copies", copies)


def _rows(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", _key().alias("key"), word_count(F.col("text")).alias("size"), _hash().alias("hash")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size x copies) of each row.

    weights: of the sources in order of code point, repeating; share: of all words that the mix
    takes; most: times that a document may be taken.
    """
    rows = _rows(docs)
    joined = with_limits(rows, limits(rows, weights, share, most), most)
    return joined.select("doc_id", "size", F.col("total").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs, all columns unchanged, as often as the mix takes them."""
    found = limits(_rows(docs), weights, share, most)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), _key().alias("key"), _hash().alias("hash"))
    return with_limits(rows, found, most).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


#: DuckDB: the same mix by sorting each source's documents by hash.
ORACLE = r"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as total,
         [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w,
         row_number() over (order by source nulls last) as pos
  from rows group by source),
filled as (
  select *, 2.0::double * total as capacity, 2.0::double * total / w as room from sources),
levels as (
  select *, (1.5::double * sum(total) over () - coalesce(sum(capacity) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as lev
  from filled window before as (order by room, pos rows between unbounded preceding and 1 preceding)),
goal as (
  select source, total, least(capacity, coalesce(w * (select arg_min(lev, (room, pos)) from levels where room > lev), capacity)) as target from levels),
need as (
  select source, total, target, case when total > 0 then floor(target / total) else 0 end as fulls from goal),
ties as (
  select source, h, sum(size) as words from rows group by source, h),
ends as (
  select t.source, h, words, sum(words) over (partition by t.source order by h) as until from ties t),
lim as (
  select e.source, arg_min(h + case when target - fulls * total - (until - words) > until - (target - fulls * total) then 1 else 0 end, h) as below
  from ends e join need n on e.source is not distinct from n.source where until > target - fulls * total group by e.source)
select r.doc_id, r.size, n.total as source_size, n.target,
       (r.size * (n.fulls + case when n.fulls < 2 and r.h < l.below then 1 else 0 end))::bigint as taken
from rows r join need n on r.source is not distinct from n.source left join lim l on r.source is not distinct from l.source
"""
