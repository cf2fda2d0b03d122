"""Ensembles and corridors: profiles on fixed bins, arrivals at transects, closest members, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import hazard
from moraine.functions.rounding import rounded


def corridor(cells: DataFrame, keys: list[str], chainage: str, length: float, bins: int) -> DataFrame:
    """Per bin: deepest, fastest, earliest wet arrival, wet cells, lowest bed. Left-closed bins, the far end in the last."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(chainage) / (length / bins))).cast("int")
    wet = F.col("depth") > 0
    return cells.withColumn("bin", at).groupBy(*keys, "bin").agg(
        F.max("depth").alias("max_depth"), F.max("speed").alias("max_speed"), F.min(F.when(wet, F.col("arrival"))).alias("arrival"), F.count_if(wet).alias("n_wet"), F.min("bed").alias("min_bed")
    )


def every_bin(profile: DataFrame, members: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Empty bins are kept, with nulls and no wet cell."""
    grid = members.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(profile, [*keys, "bin"], "left").na.fill(0, ["n_wet"])


def nearest_bin(profile: DataFrame, transects: list[tuple[int, float]], keys: list[str], length: float, bins: int) -> DataFrame:
    """The bin whose centre is nearest to each transect, the first of equals; transects are a fixed list."""
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("transect"), F.lit(x).alias("at")) for t, x in transects]))
    gap = F.abs((F.col("bin") + 0.5) * (length / bins) - F.col("at"))
    return profile.withColumn("t", rows).select("*", "t.*").groupBy(*keys, "transect").agg(F.min_by("arrival", F.struct(gap, "bin")).alias("arrival"))


def profile_gap(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """L1 difference, relative L1 and overlap of the wet parts of two profiles by bin."""
    both = a.select("bin", F.col(x).alias("a")).join(b.select("bin", F.col(x).alias("b")), "bin", "full").na.fill(0.0)
    wet = F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.nullif(F.count_if((F.col("a") > 0) | (F.col("b") > 0)), F.lit(0))
    return both.agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("l1"), F.try_divide(F.sum(F.abs(F.col("a") - F.col("b"))), F.sum("a")).alias("relative_l1"), wet.alias("iou"))


def mismatches(arrivals: DataFrame, targets: DataFrame) -> DataFrame:
    """arrivals (transect, arrival and more) with ``gap`` to the target's interval (transect, low, high), null where either lacks a time."""
    joined = arrivals.join(targets.where("low is not null and high is not null"), "transect", "left")
    return joined.withColumn("gap", F.when(F.col("low").isNotNull(), rounded(hazard.signed_gap(F.col("arrival"), F.col("low"), F.col("high")), 2))).drop("low", "high")


def closest_member(gaps: DataFrame, member: str) -> DataFrame:
    """The member that reaches most of the compared transects, then with the least mean gap; one without a gap isn't ranked."""
    per = gaps.groupBy(member).agg(F.count("gap").alias("reached"), rounded(F.avg(F.abs("gap")), 3).alias("mean_gap")).where("reached > 0")
    return per.agg(F.min(F.struct((-F.col("reached")).alias("r"), "mean_gap", member)).alias("b")).where("b is not null").select(f"b.{member}", (-F.col("b.r")).alias("reached"), "b.mean_gap")


def latest_members(index: DataFrame, member: str, place: str | Column) -> DataFrame:
    """The row of each member that stands last in the index."""
    return index.groupBy(member).agg(F.max_by(F.struct(*[c for c in index.columns if c != member]), place).alias("x")).select(member, "x.*")


def is_valid() -> Column:
    """Mass balances, repairs and shortfall are small, no step was floored and depths are finite."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return finite("balance_error") & (F.abs("balance_error") <= 1e-6) & (F.col("repaired") <= 1e-3 * F.greatest("release", F.lit(1.0))) & (F.col("shortfall") <= 1e-3) & (F.col("floor_steps") == 0) & finite("max_depth")


def index_summary(members: DataFrame) -> DataFrame:
    """Counts of valid, invalid and flagged members, percentiles of the valid ones' reach, and total time."""
    rows = members.withColumn("valid", is_valid()).withColumn("far", F.when(F.col("valid"), F.col("reach")))
    marks = [rounded(F.percentile("far", q / 100), 2).alias(f"reach_p{q}") for q in (5, 25, 50, 75, 95)]
    return rows.agg(F.count("*").alias("n_members"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(F.col("valid") & (F.size("reasons") > 0)).alias("n_flagged_kept"), *marks, F.max("far").alias("reach_max"), F.min("far").alias("reach_min"), rounded(F.sum("wall"), 1).alias("wall_total"))


def loss_interval(value: Column, damage: tuple[Column, Column], share: tuple[Column, Column]) -> tuple[Column, Column, Column, Column]:
    """Loss and avoided loss (low, high each), ends paired pessimistically and avoided clamped at 0."""
    base = value * damage[0], value * damage[1]
    low, high = base[0] * (1 - share[1]), base[1] * (1 - share[0])
    a, b = base[0] - high, base[1] - low
    return low, high, F.greatest(F.lit(0.0), F.least(a, b)), F.greatest(F.lit(0.0), F.greatest(a, b))


def block_reason(**known: Column) -> Column:
    """The first input that is missing, in the given order; null if all are known."""
    out = F.lit(None).cast("string")
    for name, x in reversed(known.items()):
        out = F.when(x.isNull(), f"no_{name}").otherwise(out)
    return out


def cumulative_trapezoid(rows: DataFrame, keys: list[str], order: str, x: str, step: float, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    part = (F.col(x) + F.lag(x).over(w)) / 2 * step
    parts = rows.withColumn("_part", F.coalesce(part, F.lit(0.0)))
    return parts.withColumn(name, F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_part")


def constrictions(profile: DataFrame, keys: list[str], spacing: float, sites: int = 12, apart: float = 2000.0, reach: float = 1500.0, least: float = 5.0) -> DataFrame:
    """Deepest narrows of a corridor: keys, bin, chainage, channel_depth, deposit of at most ``sites`` bins.

    Channel depth is the greatest bed within ``reach`` less the bin's own. Unknown beds count as the
    corridor's greatest and are no site; a corridor with fewer than five known beds has none; sites
    are ``least`` deep at least and ``apart`` from deeper ones, of equals the later bin first. A
    corridor has a fixed number of bins, so a group of the greedy part is bounded. profile: keys, bin, min_bed, deposit.
    """
    import pandas as pd

    half = max(3, round(reach / max(spacing, 1.0)))
    corridor = Window.partitionBy(*keys)
    known = profile.withColumns({"_n": F.count("min_bed").over(corridor), "_z": F.coalesce("min_bed", F.max("min_bed").over(corridor))}).where("_n >= 5")
    depth = F.max("_z").over(corridor.orderBy("bin").rowsBetween(-half, half)) - F.col("_z")
    rows = known.withColumns({"channel_depth": depth, "chainage": (F.col("bin") + 0.5) * spacing}).where((F.col("channel_depth") >= least) & F.col("min_bed").isNotNull())

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["channel_depth", "bin"], ascending=[False, False])
        taken: list[float] = []
        for x in group["chainage"]:
            if len(taken) < sites and all(abs(x - t) >= apart for t in taken):
                taken.append(x)
        return group[group["chainage"].isin(taken)]

    kinds = dict(rows.dtypes)
    columns = [*keys, "bin", "chainage", "channel_depth", "min_bed", "deposit"]
    return rows.select(*columns).groupBy(*keys).applyInPandas(pick, ", ".join(f"{c} {kinds[c]}" for c in columns))


def dam_break_chain(sites: DataFrame, width: Column, to: Column) -> DataFrame:
    """Index with its band, probabilities, dam, lake, breach and surge of each site with a deposit. sites: chainage, channel_depth, deposit."""
    rows = sites.where("deposit > 0").withColumns({"index": hazard.damming_index(F.col("deposit"), F.col("channel_depth")), "dam_height": hazard.dam_height(F.col("deposit"), F.col("channel_depth"))})
    rows = rows.withColumns({"index_low": F.col("index") * (1 - hazard.INDEX_BAND), "index_high": F.col("index") * (1 + hazard.INDEX_BAND), "volume": hazard.wedge_volume(F.col("dam_height"), width)})
    peak, rise, total = hazard.breach_wave(F.col("volume"), F.col("dam_height"))
    chances = {f"probability{x}": hazard.damming_probability(F.col(f"index{x}")) for x in ("", "_low", "_high")}
    return rows.withColumns({**chances, "peak": peak, "rise_s": rise, "duration_s": total, "surge_s": hazard.surge_travel_s(to - F.col("chainage"), F.col("dam_height"))})


def warned_losses(exposure: DataFrame, arrivals: DataFrame, scenarios: DataFrame, shape: float, spread: tuple[float, float], ramp: tuple[float, float], shares: tuple[float, float]) -> DataFrame:
    """(scenario, asset, transect, reason, lead_low, lead_high, loss_low, loss_high, avoided_low, avoided_high) of every asset in every scenario.

    exposure: asset, transect, value_low, value_high, scale (depth of the damage curve); arrivals: transect, arrival_low, arrival_high (minutes), depth_low,
    depth_high (null: not modelled); scenarios: scenario, delay_min (null: nobody is warned, the baseline, which avoids nothing). What isn't
    known blocks a loss, the first reason in order: no_transect, no_arrival, no_flow_depth, no_replacement_value. The short end of the lead
    goes with the high loss, so a warning never narrows the interval. Scenarios are few and go to every task.
    """
    held = arrivals.select("transect", "arrival_low", "arrival_high", "depth_low", "depth_high", F.lit(True).alias("_arrives"))
    rows = exposure.join(F.broadcast(held), "transect", "left").crossJoin(F.broadcast(scenarios.select("scenario", "delay_min")))
    reason = (
        F.when(F.col("transect").isNull(), "no_transect").when(F.col("_arrives").isNull(), "no_arrival").when(F.col("depth_low").isNull() | F.col("depth_high").isNull(), "no_flow_depth")
        .when(F.col("value_low").isNull() | F.col("value_high").isNull(), "no_replacement_value")
    )
    warned = F.col("delay_min").isNotNull()
    rows = rows.withColumns({"reason": reason, "lead_low": F.when(F.col("_arrives"), F.col("arrival_low") - F.col("delay_min")), "lead_high": F.when(F.col("_arrives"), F.col("arrival_high") - F.col("delay_min"))})
    free = F.col("reason").isNull()
    damage = [hazard.damage_fraction(F.col(d), F.col("scale") * k, F.lit(shape)) for d, k in (("depth_low", spread[0]), ("depth_high", spread[1]))]
    base = [F.col(v) * d for v, d in zip(("value_low", "value_high"), damage)]
    share = [F.when(warned, hazard.avoidable_share(F.col(lead), *ramp, most)).otherwise(0.0) for lead, most in (("lead_low", shares[0]), ("lead_high", shares[1]))]
    loss = [F.when(free, base[0] * (1 - share[1])), F.when(free, base[1] * (1 - share[0]))]
    avoided = [F.when(free & warned, x) for x in (base[0] - loss[1], base[1] - loss[0])]
    return rows.select("scenario", "asset", "transect", "reason", "lead_low", "lead_high", loss[0].alias("loss_low"), loss[1].alias("loss_high"), F.when(free & warned, F.greatest(F.lit(0.0), F.least(*avoided))).alias("avoided_low"), F.when(free & warned, F.greatest(F.lit(0.0), *avoided)).alias("avoided_high"))
