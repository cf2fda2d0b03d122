"""Metrics of scored predictions, order statistics, conformal intervals and cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.checkpoints import cut
from moraine.functions import hazard, quantiles

BUCKETS = 128
BROADCAST_KEYS = 10_000


def ratio(a: Column, b: Column) -> Column:
    """0 on 0 / 0, as F1 and its parts are defined here."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _all(*keys: str) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def _bucketed(values: DataFrame, keys: list[str], x: str) -> DataFrame:
    """values with ``_b``: one of ``BUCKETS`` buckets of each key, cut at approximate quantiles, so that far-off values don't crowd the others together.

    Equal values share a bucket. The place among the marks is found by halving, one plain expression a step. Marks go to
    every task if there are few keys, which is counted.
    """
    marks = F.percentile_approx(x, [k / BUCKETS for k in range(1, BUCKETS)], 10_000).alias("_marks")
    if keys:
        found = cut(values.groupBy(*keys).agg(marks))
        joined = values.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, keys)
    else:
        joined = values.crossJoin(F.broadcast(values.agg(marks)))  # one row
    out, step = joined.withColumn("_b", F.lit(0)), BUCKETS // 2
    while step:
        mark = F.get("_marks", F.col("_b") + step - 1)  # null beyond the last, as there are fewer marks for few values
        out, step = out.withColumn("_b", F.when(mark < F.col(x), F.col("_b") + step).otherwise(F.col("_b"))), step // 2
    return out.drop("_marks")


def counts_below(values: DataFrame, keys: list[str], x: str, sums: list[str]) -> DataFrame:
    """Adds for each sum c the total ``c_below`` over smaller x of the same keys.

    Running sums are taken inside a bucket of ``_bucketed`` and over the bucket totals, so a single key is
    spread over up to ``BUCKETS`` tasks. values are evaluated more than once: cut them if they are dear.
    """
    placed = _bucketed(values, keys, x)
    before = Window.partitionBy(*_all(*keys)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    starts = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(starts, [*keys, "_b"])
    out = out.withColumns({f"{c}_below": F.sum(c).over(inside) - F.col(c) + F.col(f"_s_{c}") for c in sums})
    return out.drop("_b", *[f"_s_{c}" for c in sums])


def roc_auc(scored: DataFrame, keys: list[str], score: str, positive: Column, empty: float | None = 0.5) -> DataFrame:
    """Mann-Whitney AUC with ties at one half; ``empty`` where a class has no row."""
    distinct = cut(scored.groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n")))
    below = counts_below(distinct, keys, score, ["_n"])
    wins = F.sum(F.col("_p") * (F.col("_n_below") + F.col("_n") / 2.0))
    pairs = F.sum("_p") * F.sum("_n")
    return below.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).otherwise(F.lit(empty)).cast("double").alias("auc"), F.sum("_p").alias("n_positive"), F.sum("_n").alias("n_negative"))


def precision_recall(counts: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def reliability(scored: DataFrame, probability: str, truth: Column, bins: int = 10) -> DataFrame:
    """Equal bins, the last one closed; empty bins are rows of zeros. Edges are k * (1 / bins) as doubles."""
    at = F.lit(0)
    for k in range(1, bins):
        at = at + F.when(F.col(probability) >= k * (1.0 / bins), 1).otherwise(0)
    got = scored.withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(truth.cast("double")).alias("accuracy"), F.sum(F.pow(F.col(probability) - truth.cast("double"), F.lit(2.0))).alias("squares"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").na.fill(0).select("bin", "n", "confidence", "accuracy", "squares")


def bootstrap_f1(groups: DataFrame, iterations: int, columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(draw, name, f1): groups (g from 0, counts) drawn with replacement; all names use the same draws.

    A draw's slots are hashes of (draw, slot), so reruns agree and the draws are rows, not a loop.
    """
    n = groups.count()
    spark = groups.sparkSession
    slot = F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("slot")
    picked = F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "slot")), 1, 8), 16, 10).cast("long") % max(n, 1)
    draws = spark.range(iterations).select(F.col("id").alias("draw"), slot).select("draw", picked.alias("g"))
    held = draws.join(groups, "g").groupBy("draw").agg(*[F.sum(c).alias(c) for cs in columns.values() for c in cs])
    out = None
    for name, (tp, fp, fn) in columns.items():
        one = precision_recall(held, tp, fp, fn).select("draw", F.lit(name).alias("name"), "f1")
        out = one if out is None else out.unionByName(one)
    return out


def kth_values(values: DataFrame, keys: list[str], x: str, level: float) -> DataFrame:
    """keys, n and the value at rank ceil((n + 1) level), at most n: an order statistic, not interpolated.

    Equal values are one row with a count. Bucket totals say in which bucket a key's rank lies, and only that bucket's
    values are put in order.
    """
    distinct = cut(values.where(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*keys, x).agg(F.count("*").alias("c")))
    placed = _bucketed(distinct, keys, x)
    every = Window.partitionBy(*_all(*keys))
    before = F.coalesce(F.sum("t").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("c").alias("t")).withColumns({"before": before, "n": F.sum("t").over(every)})
    target = totals.withColumn("k", quantiles.conformal_rank(F.col("n"), level)).where((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("t"))).drop("t")
    running = F.sum("c").over(every.orderBy(x)) + F.col("before")
    inside = placed.join(target, [*keys, "_b"]).withColumn("upto", running)
    return inside.where((F.col("upto") - F.col("c") < F.col("k")) & (F.col("k") <= F.col("upto"))).select(*keys, "n", x)


def conformal(rows: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Correction of intervals (low, high, truth) and their coverage before and after."""
    scored = rows.withColumn("s", hazard.conformity(F.col("low"), F.col("high"), F.col("truth")))
    fitted = cut(kth_values(scored, keys, "s", level).withColumnRenamed("s", "correction"))
    fitted = F.broadcast(fitted) if fitted.count() <= BROADCAST_KEYS else fitted
    low, high = hazard.corrected(F.col("low"), F.col("high"), F.col("correction"))
    share = lambda a, b: F.avg(F.col("truth").between(a, b).cast("double"))
    return scored.join(fitted, keys).groupBy(*keys, "n", "correction").agg(share(F.col("low"), F.col("high")).alias("before"), share(low, high).alias("after"), F.avg(high - low).alias("mean_width"))


def confusion(rows: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """truth and p0, p1, ...: how often each class was taken for each; classes that don't occur have zeros."""
    counts = rows.groupBy(truth).pivot(predicted, list(range(classes))).count()
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias(truth))
    return every.join(counts, truth, "left").na.fill(0).select(F.col(truth), *[F.col(str(k)).alias(f"p{k}") for k in range(classes)])


def calibration_error(bins: DataFrame) -> DataFrame:
    """n, Brier score and expected calibration error from the bins of ``reliability``."""
    n = F.sum("n")
    return bins.agg(n.alias("n"), (F.sum("squares") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / n).alias("ece"))
