"""Balance of receiver counts between a positive window and those matched to it, calibration of scores, seeded designs and splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.checkpoints import cut


def balanced(index: DataFrame) -> DataFrame:
    """index with ``quota`` (null without a group), ``keep`` (receivers kept) and ``orphan`` (matched to a positive that isn't there).

    index: entry, positive (boolean), matched (entry of the positive or null), n_stations. A group is
    a positive and what is matched to it; its quota is the least count in it.
    """
    group = F.when(F.col("positive"), F.col("entry")).otherwise(F.col("matched"))
    rows = index.withColumn("_g", group)
    quotas = rows.groupBy("_g").agg(F.min("n_stations").alias("quota"), F.bool_or("positive").alias("_led")).where("_led and _g is not null").drop("_led")
    out = rows.join(quotas, "_g", "left")
    return out.withColumns({"keep": F.coalesce(F.least("quota", "n_stations"), F.col("n_stations")), "orphan": ~F.col("positive") & F.col("quota").isNull()}).withColumnRenamed("_g", "group")


def count_auc(rows: DataFrame, count: str) -> DataFrame:
    """One row: how well a count alone tells positives from others, ties at one half; NaN if one of them is empty. rows: count, positive, c (how many)."""
    by = rows.groupBy(count).agg(F.sum(F.when(F.col("positive"), F.col("c")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("c"))).alias("n"))
    # A row for each number of receivers: one task orders them.
    below = F.coalesce(F.sum("n").over(Window.orderBy(count).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = F.sum("p") * F.sum("n")
    return by.withColumn("below", below).agg(F.when(pairs > 0, F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / pairs).otherwise(F.lit(float("nan"))).alias("auc"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row: mean share of receivers that a matched window and its positive both keep, over groups with a quota. rows: of ``balanced``, with station_keys."""
    kept = F.array_distinct(F.slice("station_keys", 1, F.col("quota")))
    some = rows.where("quota > 0")
    lead = some.where("positive").select("group", kept.alias("theirs"))
    return some.where("not positive").join(lead, "group").agg(F.avg(F.size(F.array_intersect(kept, "theirs")) / F.col("quota")).alias("agreement"))


def report(index: DataFrame, label: str = "label", negative: str = "tectonic") -> DataFrame:
    """One row: groups, members, groups emptied, receivers dropped, orphans, AUC of the count before, after and without orphans, and agreement."""
    rows = cut(balanced(index))
    grouped = F.col("quota").isNotNull()
    counts = rows.agg(
        F.count_distinct(F.when(grouped, F.col("group"))).alias("n_groups"), F.count_if(grouped).alias("n_bound"), F.count_if(F.col("positive") & (F.col("quota") == 0)).alias("n_emptied"),
        F.sum(F.when(grouped, F.col("n_stations") - F.col("keep"))).alias("n_dropped"), F.count_if("orphan").alias("n_orphans"),
    )
    # Both AUCs need only how many rows have each count, before and after: a few rows, counted once.
    few = cut(rows.where(F.col("positive") | (F.col(label) == negative)).groupBy("n_stations", "keep", "orphan", "positive").agg(F.count("*").alias("c")))
    for name, part, count in (("auc_before", few, "n_stations"), ("auc_after", few, "keep"), ("auc_without_orphans", few.where("not orphan"), "keep")):
        counts = counts.crossJoin(count_auc(part, count).select(F.col("auc").alias(name)))  # one row each
    return counts.crossJoin(agreement(rows))


def means(index: DataFrame, label: str = "label") -> DataFrame:
    """Mean receivers of each class before and after."""
    return balanced(index).groupBy(label).agg(F.avg("n_stations").alias("before"), F.avg("keep").alias("after"))


MOST_SCORES = 262_144


def sigmoid(scored: DataFrame, score: str, positive: Column, iterations: int = 200, rate: float = 0.5) -> tuple[float, float]:
    """Slope and intercept of a logistic over scores by gradient steps on the log loss.

    Targets are drawn off 0 and 1 by the class counts. Equal scores are one row with its counts. Up to ``MOST_SCORES``
    distinct scores come to the driver, a bounded table on which all steps are sums of arrays; beyond that each
    step is one aggregation, and two numbers come back from it.
    """
    rows = cut(scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")))
    p, n, distinct = rows.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    high, low = (p + 1) / (p + 2) if p else 0.5, 1 / (n + 2) if n else 0.5
    if distinct <= MOST_SCORES:
        x, ps, ns = (np.array(v, float) for v in zip(*rows.orderBy("x").collect())) if distinct else (np.empty(0),) * 3

        def gradient(slope: float, intercept: float) -> tuple[float, float]:
            q = 1 / (1 + np.exp(-(x * slope + intercept)))
            off = ps * (q - high) + ns * (q - low)
            return float(off @ x), float(off.sum())

    else:

        def gradient(slope: float, intercept: float) -> tuple[float, float]:
            q = 1 / (1 + F.exp(-(F.col("x") * slope + intercept)))
            off = F.col("p") * (q - high) + F.col("n") * (q - low)
            return tuple(rows.agg(F.sum(off * F.col("x")), F.sum(off)).first())

    slope, intercept = 1.0, 0.0
    for _ in range(iterations if p + n else 0):
        a, b = gradient(slope, intercept)
        slope, intercept = slope - rate * a / (p + n), intercept - rate * b / (p + n)
    return slope, intercept


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a deviation below 1e-8 counts as 1."""
    found = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    one = F.broadcast(found)  # one row
    return rows.crossJoin(one).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).drop(*found.columns)


def hash_ranked(rows: DataFrame, key: str, seed: int, dim: int, name: str) -> DataFrame:
    """rows with their place from 1 in a seeded order, by a hash of the key, then by key; the same on every run.

    A hash is spread evenly, so its leading byte cuts the order into 256 pieces of equal size: rows are
    counted by piece, and each piece is ranked by itself.
    """
    h = F.xxhash64(F.lit(seed), F.lit(dim), F.col(key))
    placed = rows.withColumns({"_h": h, "_piece": F.shiftright(h, 56)})
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(placed.groupBy("_piece").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n"))  # 256 rows
    place = F.row_number().over(Window.partitionBy("_piece").orderBy("_h", key)) + F.col("_before")
    return placed.join(starts, "_piece").withColumn(name, place).drop("_h", "_piece", "_before")


def latin_hypercube(members: DataFrame, key: str, dims: int, seed: int) -> DataFrame:
    """members with u0, u1, ...: in each dimension every one of n strata's centres is held once, in a seeded order of its own."""
    total, out = members.count(), members
    for d in range(dims):
        out = hash_ranked(out, key, seed, d, f"u{d}").withColumn(f"u{d}", (F.col(f"u{d}") - 0.5) / total)
    return out


def split_by_run(rows: DataFrame, run: str, seed: int, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """rows with ``split``: runs in a seeded order, the first shares (rounded half to even) train and validate, the rest test; a run is never divided."""
    runs = cut(rows.select(run).distinct())
    n = runs.count()
    a, b = round(train * n), round(val * n)
    placed = hash_ranked(runs, run, seed, 0, "_r")
    return rows.join(placed, run).withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "val").otherwise("test")).drop("_r")


def overlap(splits: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split; none if the splits are disjoint."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key)
