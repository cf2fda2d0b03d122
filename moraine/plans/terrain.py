"""Slope units, rasters warped onto a grid, and resampled inversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.checkpoints import cut
from moraine.operators import balance, grids, resampling, surrogate, units
from moraine.plans.base import query, rounded
from moraine.tables import table

STEP_M = 30.0


def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells of a grid 200 wide: ridges and valleys, roughened by the events' values; every 97th has no elevation."""
    k, c = F.col("event_id"), F.col("event_id") % 200
    r = F.floor(k / 200)
    z = 3000 + 900 * F.sin(r / 37.0) * F.cos(c / 29.0) + 300 * F.sin((r + c) / 11.0) + F.col("value") / 20
    return table(spark, sf_dir, "events").select(r.alias("r"), c.alias("c"), F.when(k % 97 != 0, z).alias("z"))


@query()
def slope_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, elevations, mean slope and aspect of each slope unit."""
    cells = cut(units.delineate(elevations(spark, sf_dir), STEP_M))
    return grids.zonal(cells.drop("unit"), cells.select("r", "c", "unit"), STEP_M * STEP_M)


# The forces that the traces of the resampled inversions hold, sample by sample.
FORCES = {"up": (0.0, 3.0, -2.0, 0.5), "north": (1.0, 2.0, -1.0, -0.5), "east": (0.5, -2.0, 1.5, 0.0)}


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as traces of 13 stations an event: the planted forces through three kernels, with noise, at two depths."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    kernels = {"up": e, "north": F.reverse(e), "east": F.concat(F.slice(e, 21, 44), F.slice(e, 1, 20))}
    rows = table(spark, sf_dir, "embeddings").where("label is not null and size(embedding) = 64").select("vec_id", "label", *[k.alias(n) for n, k in kernels.items()])

    def term(i: Column) -> Column:
        return sum(f * F.coalesce(F.get(name, (i - k).cast("int")), F.lit(0.0)) for name, forces in FORCES.items() for k, f in enumerate(forces) if f)

    noise = lambda i: 0.1 * F.get("up", ((i * 37 + 11) % 64).cast("int"))
    data = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: term(i) + noise(i))
    depth = F.explode(F.array(F.lit(500.0), F.lit(2000.0))).alias("depth_m")
    rows = rows.select("label", (F.col("vec_id") % 13).alias("station"), depth, data.alias("data"), *kernels)
    deep = lambda n: F.transform(n, lambda x: x * F.when(F.col("depth_m") > 1000, 0.97).otherwise(1.0))
    return rows.select("label", "station", "depth_m", "data", F.array(*[deep(n) for n in kernels]).alias("kernels"), F.lit(1.0).alias("weight"))


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bootstrap(traces(spark, sf_dir), "label", "station", "depth_m", 4, [500.0, 2000.0])


@query()
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred resampled inversions of each event, with peak force, azimuth and masses."""
    drawn = _draws(spark, sf_dir)
    scalars = resampling.draw_scalars(drawn, "label", 1.0).drop("friction")
    return drawn.drop("forces").join(scalars, ["label", "draw"], "left")


@query()
def bootstrap_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the force at each sample, beside the force that was planted."""
    found = resampling.envelope(_draws(spark, sf_dir), "label")
    planted = F.create_map(*[x for n, forces in FORCES.items() for x in (F.lit(n), F.array(*[F.lit(v) for v in forces]))])
    return found.withColumn("planted", F.get(planted[F.col("component")], F.col("i")))


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of peak force, impulse, duration, azimuth and masses over the draws."""
    return resampling.intervals(resampling.draw_scalars(_draws(spark, sf_dir), "label", 1.0), "label")


SOURCE, TARGET = grids.Grid(100.0, 900.0, 10.0, 50, 40), grids.Grid(83.0, 917.0, 25.0, 18, 17)
#: Overlaps of each source cell with the cells of the target, in SQL.
OVERLAPS = """
with g as (select p_partkey // 40 as r, p_partkey % 40 as c, {value} as v from part where p_partkey // 40 < 50),
s as (select *, (100 + c * 10 - 83) / 25.0::double as e0, (917 - 900 + r * 10) / 25.0::double as s0 from g where v <> {nodata}),
k as (select i as r, j as c, v, (least(s0 + 0.4::double, i + 1) - greatest(s0, i)) * (least(e0 + 0.4::double, j + 1) - greatest(e0, j)) as w
  from s, range(18) a(i), range(17) b(j) where least(s0 + 0.4::double, i + 1) - greatest(s0, i) > 1e-9 and least(e0 + 0.4::double, j + 1) - greatest(e0, j) > 1e-9),
every as (select i as r, j as c from range(18) a(i), range(17) b(j))
"""


def _field(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 40).alias("r"), (k % 40).alias("c"), F.expr(value).cast("double").alias("value")).where("r < 50")


@query(OVERLAPS.format(value="p_retailprice::double", nodata="904") + "select r, c, round(coalesce(sum(w * v) / sum(w), -1), 6) as value from every left join k using (r, c) group by r, c")
def warped_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices on a coarser grid that begins outside: means by common area; 904 stands for no data, -1 for none in the target."""
    return grids.warp(_field(spark, sf_dir, "p_retailprice"), SOURCE, TARGET, "average", 904.0, -1.0).withColumn("value", rounded("value"))


@query(
    OVERLAPS.format(value="(p_size % 7)::double", nodata="3")
    + ", a as (select r, c, v, round(sum(w), 9) as w from k group by r, c, v), m as (select r, c, v from a qualify row_number() over (partition by r, c order by w desc, v) = 1) select r, c, coalesce(v, -1) as value from every left join m using (r, c)"
)
def warped_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that covers most of each target cell; class 3 stands for no data."""
    return grids.warp(_field(spark, sf_dir, "p_size % 7"), SOURCE, TARGET, "mode", 3.0, -1.0)


@query(
    """
with g as (select p_partkey // 40 as r, p_partkey % 40 as c, (p_size % 7)::double as v from part where p_partkey // 40 < 50),
every as (select i as r, j as c, floor((900 - (917 - (i + 0.5) * 25)) / 10)::bigint as y, floor((83 + (j + 0.5) * 25 - 100) / 10)::bigint as x from range(18) a(i), range(17) b(j))
select every.r, every.c, coalesce(v, -1) as value from every left join g on g.r = y and g.c = x and v <> 3"""
)
def warped_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class at the middle of each target cell."""
    return grids.warp(_field(spark, sf_dir, "p_size % 7"), SOURCE, TARGET, "nearest", 3.0, -1.0)


@query()
def bearing_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the ground falls along each supplier's bearing over the grid of events."""
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(k.alias("id"), (30 - 0.002 * (k % 5)).alias("latitude"), (79 + 0.004 * (k * 13 % 41)).alias("longitude"), (90.0 + k * 37 % 90).alias("azimuth"))
    cells = elevations(spark, sf_dir).where("z is not null").withColumnRenamed("z", "value")
    return surrogate.terrain_profiles(sources, "id", cells, (30.0, 79.0), 0.001, 6000.0, 250.0)


@query()
def boosted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by split, label and the class that boosted trees of the train split give them; runs are sources, and none is in two splits."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.length("text").alias("n"), F.size(F.split("text", " ")).alias("words"), F.length(F.regexp_replace("text", "[a-z ]", "")).alias("odd"))
    rows = balance.split_by_run(d.join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id"), "source", 20260903)
    features = ["n_chars", "n", "words", "odd"]
    rows = cut(rows.select("doc_id", "split", "source", "quality", *[F.coalesce(F.col(f), F.lit(0)).cast("double").alias(f) for f in features]))
    if balance.overlap(rows, "source").count():
        raise ValueError("a source is in more than one split")
    seen = rows.where("split <> 'test'")
    models = surrogate.boosted_trees(seen, features, "quality", "split", 2, rounds=5, depth=3)
    return surrogate.predicted(models, rows, features).groupBy("split", "quality", "predicted").agg(F.count("*").alias("n"))
