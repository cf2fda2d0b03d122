"""Regular grids as cell tables: bilinear reading, zonal statistics, resampling onto another grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.quantiles import circular_mean_deg
from moraine.functions.rounding import rounded


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, value) of a field (r, c, value) at points (id, y, x) in cell units; null where a corner is missing.

    Each point is sent to its four corners with their weights: one equi-join and one sum.
    """
    r0, c0 = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - r0, F.col("x") - c0
    corners = [F.struct((r0 + i).alias("r"), (c0 + j).alias("c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)]
    asked = points.select("id", F.explode(F.array(*corners)).alias("k")).select("id", "k.*").where("w > 0")
    held = asked.join(cells.select("r", "c", "value"), ["r", "c"], "left")
    return held.groupBy("id").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def zonal(cells: DataFrame, units: DataFrame, area: float) -> DataFrame:
    """Size, mean slope, circular mean aspect and elevation range of each unit."""
    rows = cells.join(units, ["r", "c"])
    return rows.groupBy("unit").agg(
        F.count("*").alias("n"), (F.count("*") * F.lit(area)).alias("area"), F.avg("slope").alias("mean_slope"), circular_mean_deg(F.col("aspect")).alias("mean_aspect"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z")
    )


@dataclass(frozen=True)
class Grid:
    """North-up cells: x of the left edge, y of the top edge, size of a cell, rows and columns. Row 0 is the northernmost."""

    x0: float
    y0: float
    step: float
    rows: int
    cols: int


EDGE = 1e-9  # share of a cell below which an overlap is rounding


def _valid(cells: DataFrame, nodata: float | None) -> DataFrame:
    good = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    return cells.where(good if nodata is None else good & (F.col("value") != nodata))


def _every(spark: SparkSession, target: Grid) -> DataFrame:
    cells = spark.range(target.rows * target.cols)
    return cells.select(F.floor(F.col("id") / target.cols).alias("r"), (F.col("id") % target.cols).alias("c"))


def overlaps(cells: DataFrame, source: Grid, target: Grid, nodata: float | None = None) -> DataFrame:
    """(r, c, value, w) of every source cell with data and target cell that overlap, w their common area.

    A source cell is sent to the few target cells that it touches: nothing is compared.
    """

    def span(low: Column, name: str) -> Column:
        # Cells of the target, in its units, along one axis: where a source cell begins and ends.
        high = low + source.step / target.step
        first, last = F.floor(low + EDGE), F.ceil(high - EDGE) - 1
        return F.explode(F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias(name), (F.least(high, k + 1) - F.greatest(low, k.cast("double"))).alias(f"w{name}"))))

    east = (F.lit(source.x0) + F.col("_c") * source.step - target.x0) / target.step
    south = (F.lit(target.y0) - source.y0 + F.col("_r") * source.step) / target.step
    rows = _valid(cells, nodata).select(F.col("r").alias("_r"), F.col("c").alias("_c"), "value")
    both = rows.withColumn("i", span(south, "r")).withColumn("j", span(east, "c")).select("i.r", "j.c", "value", (F.col("i.wr") * F.col("j.wc")).alias("w"))
    return both.where(F.col("r").between(0, target.rows - 1) & F.col("c").between(0, target.cols - 1) & (F.col("w") > EDGE))


def warp(cells: DataFrame, source: Grid, target: Grid, kind: str, nodata: float | None = None, fill: float | None = None) -> DataFrame:
    """(r, c, value) of every cell of the target grid; ``fill`` where no source cell with data lies.

    average: mean weighted by common area; mode: the value of most common area, of equals the smallest; nearest: the
    source cell in which the target cell's middle lies. Both grids are in one projection.
    """
    every = _every(cells.sparkSession, target)
    if kind == "nearest":
        y = (F.lit(source.y0) - (F.lit(target.y0) - (F.col("r") + 0.5) * target.step)) / source.step
        x = (F.lit(target.x0) + (F.col("c") + 0.5) * target.step - source.x0) / source.step
        asked = every.withColumns({"_r": F.floor(y), "_c": F.floor(x)})
        held = _valid(cells, nodata).select(F.col("r").alias("_r"), F.col("c").alias("_c"), "value")
        return asked.join(held, ["_r", "_c"], "left").select("r", "c", F.coalesce("value", F.lit(fill)).alias("value"))
    met = overlaps(cells, source, target, nodata)
    if kind == "average":
        found = met.groupBy("r", "c").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    elif kind == "mode":
        # Areas are rounded, so that equal ones are ties.
        area = met.groupBy("r", "c", "value").agg(rounded(F.sum("w"), 9).alias("w"))
        found = area.groupBy("r", "c").agg(F.min_by("value", F.struct(-F.col("w"), F.col("value"))).alias("value"))
    else:
        raise ValueError(f"no resampling {kind!r}")
    return every.join(found, ["r", "c"], "left").select("r", "c", F.coalesce("value", F.lit(fill)).alias("value"))
