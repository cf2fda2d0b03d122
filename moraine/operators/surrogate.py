"""Evaluation of emulated corridors, releases, terrain profiles, location by inversion at every node, and boosted trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.checkpoints import cut
from moraine.functions.geo import EARTH_KM
from moraine.operators import evaluate, grids, inversion

# Depth that counts as wet, and how far a release band widens.
WET_M = 1.0
WIDEN_M, WIDEN_MOST_M = 100.0, 3000.0


def overlap_by_member(bins: DataFrame, member: str) -> DataFrame:
    """(member, iou): shared share of wet bins; members that are dry in both have no row. bins: member, truth, median (depths), reach (probability)."""
    said, true = (F.col("median") > WET_M) & (F.col("reach") > 0.5), F.col("truth") > WET_M
    return bins.groupBy(member).agg(F.count_if(said | true).alias("n"), F.count_if(said & true).alias("both")).where("n > 0").select(member, (F.col("both") / F.col("n")).alias("iou"))


def interval_coverage(bins: DataFrame) -> DataFrame:
    """One row: share of truths in their interval over wet bins and over all, null where there is none. bins: truth, low, high."""
    inside = F.col("truth").between(F.col("low"), F.col("high")).cast("double")
    return bins.agg(F.avg(F.when(F.col("truth") > WET_M, inside)).alias("wet"), F.avg(inside).alias("all"))


def arrival_errors(arrivals: DataFrame, transect: str) -> DataFrame:
    """(transect, n, mae, stage_error) over members that reach it: mean absolute error of the arrival, and of the stage relative to the mean stage. arrivals: transect, truth, median, stage, stage_median."""
    got = F.col("truth").isNotNull() & ~F.isnan("truth")
    error = lambda a, b: F.avg(F.when(got, F.abs(F.col(a) - F.col(b))))
    return arrivals.groupBy(transect).agg(F.count_if(got).alias("n"), error("median", "truth").alias("mae"), (error("stage_median", "stage") / F.nullif(F.avg(F.when(got, F.abs("stage"))), F.lit(0.0))).alias("stage_error"))


def releases(cells: DataFrame, members: DataFrame, cell_area: float, head_m: float = 6000.0, most_depth: float = 300.0) -> DataFrame:
    """(member, cells, depth, low, high, shortfall): a volume spread evenly over the cells of an elevation band near the head.

    The band widens by steps until its cells hold the volume at the greatest depth, or by as much as it may; a band that
    holds no cell takes the highest cells instead. cells: z, chainage; members: member, volume, low, high. A band's cells are those up to its upper edge less those
    below its lower one, from running counts over heights and edges: no member meets a cell.
    """
    last = int(WIDEN_MOST_M / WIDEN_M)
    need = F.col("volume") / most_depth / cell_area
    heights = cut(cells.where((F.col("chainage") <= head_m) & F.col("z").isNotNull()).groupBy(F.col("z").cast("double").alias("x")).agg(F.count("*").alias("k")))
    steps = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("step")
    bands = members.select("member", "volume", "low", "high", steps).withColumns({"_a": F.col("low") - F.col("step") * WIDEN_M, "_b": F.col("high") + F.col("step") * WIDEN_M})
    # Counts below each height and each edge of a band; equal edges of many members are counted once.
    edges = bands.select(F.explode(F.array("_a", "_b")).alias("x")).distinct().select("x", F.lit(0).cast("long").alias("k"))
    merged = cut(heights.unionByName(edges).groupBy("x").agg(F.sum("k").alias("k")))
    below = cut(evaluate.counts_below(merged, [], "x", ["k"]).select("x", "k", F.col("k_below").alias("below")))
    under, upto = below.select(F.col("x").alias("_a"), F.col("below").alias("_under")), below.select(F.col("x").alias("_b"), (F.col("below") + F.col("k")).alias("_upto"))
    tried = bands.join(under, "_a").join(upto, "_b").withColumn("n", F.col("_upto") - F.col("_under")).where("n > 0")
    found = tried.groupBy("member", "volume", "low", "high").agg(F.min(F.when(F.col("n") >= need, F.struct("step", "n"))).alias("fit"), F.max(F.struct("step", "n")).alias("most"))
    used = F.coalesce("fit.n", "most.n")
    wide = F.coalesce(F.col("fit.step"), F.lit(last)) * WIDEN_M
    banded = cut(found.select("member", "volume", used.alias("cells"), (F.col("low") - wide).alias("low"), (F.col("high") + wide).alias("high")))
    # The others take so many of the highest cells: places from the top, by blocks of places, each with the height that begins last in it.
    total = heights.agg(F.sum("k").alias("total"), F.max("x").alias("top")).where("total > 0")  # one row
    missed = members.select("member", "volume").join(banded.select("member"), "member", "left_anti").crossJoin(F.broadcast(total))
    missed = missed.withColumn("cells", F.least(F.greatest(F.lit(1), F.floor(need)), F.col("total")).cast("long"))
    block = 4096
    most = missed.agg(F.max("cells").alias("most"))
    starts = below.where("k > 0").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(most)).withColumn("at", F.col("total") - F.col("below") - F.col("k")).where("at < most").select("at", "x", F.floor(F.col("at") / block).alias("block"))
    takes = missed.select((F.col("cells") - 1).alias("place")).distinct().withColumn("block", F.floor(F.col("place") / block))
    own = takes.join(starts, "block", "left").groupBy("place", "block").agg(F.max(F.when(F.col("at") <= F.col("place"), F.struct("at", "x"))).alias("own"))
    ends = starts.groupBy("block").agg(F.max(F.struct("at", "x")).alias("end"))
    earlier = F.max("end").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = takes.select("block").distinct().join(ends, "block", "full").select("block", earlier.alias("before"))
    lowest = own.join(blocks, "block").select((F.col("place") + 1).alias("cells"), F.coalesce("own.x", "before.x").alias("low"))
    highest = missed.join(lowest, "cells").select("member", "volume", "cells", "low", F.col("top").alias("high"))
    every = banded.unionByName(highest)
    depth = F.least(F.col("volume") / (F.col("cells") * cell_area), F.lit(most_depth))
    return every.select("member", "cells", depth.alias("depth"), "low", "high", (1 - depth * F.col("cells") * cell_area / F.nullif(F.col("volume"), F.lit(0.0))).alias("shortfall"))


def bearing_points(sources: DataFrame, most_m: float, step_m: float) -> DataFrame:
    """sources (latitude, longitude, azimuth and more) with ``i``, ``distance``, and the place at each step along the bearing."""
    n = max(int(most_m / step_m) + 1, 2)
    a = F.radians("azimuth")
    degree = EARTH_KM * np.pi / 180 * 1000
    rows = sources.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("distance", F.col("i") * step_m)
    return rows.withColumns({"lat": F.col("latitude") + F.col("distance") * F.cos(a) / degree, "lon": F.col("longitude") + F.col("distance") * F.sin(a) / (degree * F.greatest(F.cos(F.radians("latitude")), F.lit(1e-6)))})


def terrain_profiles(sources: DataFrame, key: str, cells: DataFrame, origin: tuple[float, float], cell_deg: float, most_m: float, step_m: float) -> DataFrame:
    """(key, distance, drop, n): the leading run of known samples along each bearing, and how far each lies below the first; at least two.

    cells: r (south from the origin's latitude), c (east of its longitude), value. A profile that leaves the field and returns ends where it left.
    """
    at = bearing_points(sources, most_m, step_m)
    points = at.select(F.struct(key, "i").alias("id"), ((F.lit(origin[0]) - F.col("lat")) / cell_deg).alias("y"), ((F.col("lon") - origin[1]) / cell_deg).alias("x"))
    seen = grids.bilinear(points, cells).select(F.col(f"id.{key}").alias(key), F.col("id.i").alias("i"), "value")
    along = Window.partitionBy(key).orderBy("i")
    run = seen.withColumn("_gone", F.sum(F.when(F.col("value").isNull() | (F.col("value") <= -1000), 1).otherwise(0)).over(along)).where("_gone = 0")
    out = run.withColumns({"drop": F.first("value").over(along) - F.col("value"), "n": F.count("*").over(Window.partitionBy(key))})
    return out.where("n > 1").select(key, (F.col("i") * step_m).alias("distance"), "drop", "n")


def variance_reduction(traces: DataFrame, node: str, n_basis: int, damping: float) -> DataFrame:
    """(node, variance_reduction): how much of the data each node's kernels explain at one damping. traces: node, kernel, data.

    Normal equations and the data's energy add up over a node's traces, so a task sends sums of a fixed size for
    each node it meets, and a node is solved from them alone.
    """
    kind = dict(traces.dtypes)[node]
    cells = n_basis * (n_basis + 1) + 1

    def add(batches):
        total: dict = {}
        for batch in batches:
            for key, kernel, data in zip(batch[node], batch["kernel"], batch["data"]):
                a, d = inversion.design(np.asarray(kernel, float), n_basis), np.asarray(data, float)
                total[key] = total.get(key, 0) + np.concatenate(((a.T @ a).ravel(), a.T @ d, [d @ d]))
            if len(total) > 4096:
                yield pd.DataFrame([(k, v.tolist()) for k, v in total.items()], columns=[node, "sums"])
                total = {}
        yield pd.DataFrame([(k, v.tolist()) for k, v in total.items()], columns=[node, "sums"])

    parts = traces.select(node, "kernel", "data").mapInPandas(add, f"{node} {kind}, sums array<double>")
    whole = parts.select(node, F.posexplode("sums").alias("i", "x")).groupBy(node, "i").agg(F.sum("x").alias("x")).groupBy(node).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sums"))

    def solve(batches):
        for batch in batches:
            out = []
            for sums in batch["sums"]:
                v = np.asarray(sums, float)
                ata, atd, energy = v[: n_basis**2].reshape(n_basis, n_basis), v[n_basis**2 : cells - 1], v[-1]
                m = np.linalg.solve(ata + damping * (np.trace(ata) / n_basis or 1.0) * np.eye(n_basis), atd)
                out.append(1 - (energy - 2 * m @ atd + m @ ata @ m) / energy if energy > 0 else 0.0)
            yield pd.DataFrame({node: batch[node], "variance_reduction": out})

    return whole.mapInPandas(solve, f"{node} {kind}, variance_reduction double")


def grid_search(traces: DataFrame, source: str, node: str, n_basis: int, damping: float) -> DataFrame:
    """(source, node, variance_reduction) of each source's best node, the smaller of equals. traces: source, node, kernel, data."""
    both = traces.withColumn("_k", F.struct(F.col(source).alias("s"), F.col(node).alias("n"))).withColumn("_key", F.to_json("_k"))
    found = variance_reduction(both, "_key", n_basis, damping)
    named = found.join(both.select("_key", source, node).distinct(), "_key")
    return named.groupBy(source).agg(F.min_by(F.struct(node, "variance_reduction"), F.struct(-F.round("variance_reduction", 12), F.col(node))).alias("b")).select(source, "b.*")


def boosted_trees(rows: DataFrame, features: list[str], label: str, split: str, classes: int, rounds: int = 40, depth: int = 4):
    """One model a class by gradient boosting on train rows, stopped by those of val, rows weighed by their class; ``predicted`` adds the likeliest class.

    A test row is refused, so that training can't see one.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    if rows.where(~F.col(split).isin("train", "val")).limit(1).count():
        raise ValueError("only train and val rows may be given")
    counts = {r[0]: r[1] for r in rows.where(F.col(split) == "train").groupBy(label).count().collect()}  # a row a class
    total = sum(counts.values())
    weight = F.lit(0.0)
    for k, n in counts.items():
        weight = F.when(F.col(label) == k, total / (classes * n)).otherwise(weight)
    seen = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows.withColumns({"_w": weight, "_val": F.col(split) == "val"}))
    models = []
    for k in range(classes):
        one = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", validationIndicatorCol="_val", maxIter=rounds, maxDepth=depth, seed=1, predictionCol=f"_p{k}").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_q{k}")
        models.append(one.fit(seen.withColumn("_y", (F.col(label) == k).cast("double"))))
    return models


def predicted(models: list, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with ``predicted``, the class of the greatest margin, of equals the first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)
    for model in models:
        out = model.transform(out)
    margins = F.array(*[F.struct(vector_to_array(f"_r{k}")[1].alias("m"), F.lit(-k).alias("k")) for k in range(len(models))])
    return out.withColumn("predicted", -F.array_max(margins)["k"]).select(*rows.columns, "predicted")


def neighbourhood(units: DataFrame, zone: str) -> DataFrame:
    """(zone, measurable, why, n): units that were never measurable by the last step's reason, and the others by the best tier that they reached. units: zone, ever, reason, tier."""
    why = F.when(F.col("ever"), F.col("tier")).otherwise(F.coalesce("reason", F.lit("unknown")))
    return units.groupBy(zone, F.col("ever").alias("measurable"), why.alias("why")).agg(F.count("*").alias("n"))


def refusing_watch(units: DataFrame, key: str, step: Column) -> DataFrame:
    """(key, step, tier, score, reason): a watch without trained weights says so and gives no score."""
    return units.select(key, step.alias("step"), F.lit("insufficient_data").alias("tier"), F.lit(None).cast("double").alias("score"), F.lit("model_not_trained").alias("reason"))


def by_orbit(products: DataFrame, orbit: str, time: str, name: str) -> DataFrame:
    """(orbit, products): names in order of time, then name."""
    return products.groupBy(orbit).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, name))), lambda x: x[name]).alias("products"))


def request_states(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """(request, state, recorded_at): the latest status of each request in the ledger, or unknown. ledger: request, status, recorded_at, place."""
    last = ledger.where("request is not null").groupBy("request").agg(F.max_by(F.struct("status", "recorded_at"), F.struct("recorded_at", -F.col("place"))).alias("x"))
    return requests.select("request").distinct().join(last, "request", "left").select("request", F.coalesce("x.status", F.lit("unknown")).alias("state"), "x.recorded_at")
