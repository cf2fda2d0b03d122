"""Components and shortest paths of edge tables by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.checkpoints import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (src, dst) reaches.

    Each round takes the least label among neighbours and then that label's own label, so rounds
    grow slower than the diameter.
    """
    both = stored(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("component"))
    while True:
        labels = stored(labels)
        seen = both.join(labels, both["dst"] == labels["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("next"))
        least = labels.join(seen, "node").select("node", "component", F.least("component", "next").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        found = stored(least.join(jump, "next").select("node", "component", F.least("next", "far").alias("new")))
        if found.where("new <> component").isEmpty():
            return labels
        labels = found.select("node", F.col("new").alias("component"))


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """(node, distance, via) from one node over undirected edges (src, dst, length); only improved nodes are sent on."""
    both = stored(edges.select("src", "dst", "length").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")))
    known = stored(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("via")))
    fresh = known
    while True:
        reach = both.join(fresh, both["src"] == fresh["node"]).groupBy("dst").agg(F.min(F.struct((F.col("distance") + F.col("length")).alias("distance"), F.col("src").alias("via"))).alias("r"))
        old = known.select(F.col("node").alias("dst"), F.col("distance").alias("d"))
        better = stored(reach.join(old, "dst", "left").where("d is null or r.distance < d").select(F.col("dst").alias("node"), "r.distance", "r.via"))
        if better.isEmpty():
            return known
        known = stored(known.join(better.select("node"), "node", "left_anti").select("node", "distance", "via").unionByName(better))
        fresh = better
