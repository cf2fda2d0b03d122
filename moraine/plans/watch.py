"""Unit series: cubes, slopes, peers, walk-forward tiers and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import quantiles as Q
from moraine.operators import watch
from moraine.plans.base import DAY_US, micros, query, rounded
from moraine.tables import table

#: The supplied series last 30 days: spans are days where those of the field are months.
CONFIG = watch.WatchConfig(slope_days=7.0, span_days=21.0, min_samples=10, min_history=4, min_coherence=0.30, min_sensitivity=0.30, first_step=10, last_step=30, every=1)
START_US = 1_704_067_200_000_000


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), ((micros("ts") - START_US) / DAY_US).alias("t"), F.col("value").alias("v"), k.alias("coh"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity and footprint of each unit, from its id."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id")).distinct()
    return rows.select("unit_id", (F.col("unit_id") % 19 != 7).alias("inside"), (((F.col("unit_id") * 37) % 100 + 5) / 100).alias("sens"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = watch.at_steps(samples(spark, sf_dir), CONFIG)
    known = units(spark, sf_dir)
    scaled = dealt.join(known.select("unit_id", "sens"), "unit_id").withColumn("v", F.col("v") / F.col("sens"))
    return watch.unit_states(scaled, known, CONFIG)


SAMPLES = """
samples as (
  select user_id as unit_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0::double as t, value as v, cast(props->>'$.k' as double) / 100 as coh from events),
units as (
  select distinct user_id as unit_id, user_id % 19 <> 7 as inside, ((user_id * 37) % 100 + 5) / 100.0::double as sens from events),
steps as (select unnest(range(10, 31))::bigint as step)"""

STATES = (
    SAMPLES
    + """,
raw as (
  select u.unit_id, p.step, count(s.v) as n_samples,
    quantile_cont(case when s.t > p.step - 7 then s.coh end, 0.5) as median_coherence,
    case when count(s.v) filter (where s.t > p.step - 7) >= 3 then 365.25 * regr_slope(case when s.t > p.step - 7 then s.v / u.sens end, case when s.t > p.step - 7 then s.t end) end as velocity,
    case when count(s.v) filter (where s.t > p.step - 14 and s.t <= p.step - 7) >= 3 then
      365.25 * regr_slope(case when s.t > p.step - 14 and s.t <= p.step - 7 then s.v / u.sens end, case when s.t > p.step - 14 and s.t <= p.step - 7 then s.t end) end as earlier
  from units u cross join steps p left join samples s on s.unit_id = u.unit_id and s.t <= p.step and s.t > p.step - 21
  group by all),
states as (
  select raw.unit_id, step, n_samples, median_coherence, velocity, (velocity - earlier) / (7 / 365.25::double) as acceleration,
    case when not inside then 'outside_footprint' when abs(sens) < 0.30 then 'low_los_sensitivity' when n_samples < 10 then 'too_few_samples'
         when coalesce(median_coherence, 0) < 0.30 then 'low_coherence' end as reason
  from raw join units using (unit_id))"""
)

SCORED = (
    STATES
    + """,
past as (
  select s.unit_id, s.step, h.velocity as v, h.acceleration as a from states s join states h on h.unit_id = s.unit_id and h.step < s.step and h.reason is null),
pastc as (
  select unit_id, step, count(*) as n, count(v) as nv, count(a) as na, quantile_cont(v, 0.5) as vm, quantile_cont(v, 0.25) as v1, quantile_cont(v, 0.75) as v3,
    quantile_cont(a, 0.5) as am, quantile_cont(a, 0.25) as a1, quantile_cont(a, 0.75) as a3 from past group by all),
pasts as (
  select c.unit_id, c.step, n, nv, na, vm, am, quantile_cont(abs(v - vm), 0.5) as vd, quantile_cont(abs(a - am), 0.5) as ad, any_value(v3 - v1) as vi, any_value(a3 - a1) as ai
  from pastc c join past using (unit_id, step) group by all),
peerc as (
  select step, quantile_cont(velocity, 0.5) as vm, quantile_cont(velocity, 0.75) - quantile_cont(velocity, 0.25) as vi,
    quantile_cont(acceleration, 0.5) as am, quantile_cont(acceleration, 0.75) - quantile_cont(acceleration, 0.25) as ai from states where reason is null group by step),
peers as (
  select step, vm as pvm, any_value(vi) as pvi, am as pam, any_value(ai) as pai, quantile_cont(abs(velocity - vm), 0.5) as pvd, quantile_cont(abs(acceleration - am), 0.5) as pad
  from peerc join states using (step) where reason is null group by all),
z as (
  select s.unit_id, s.step, s.n_samples, s.median_coherence, s.velocity, s.acceleration, coalesce(s.reason, case when coalesce(n, 0) < 4 then 'too_little_history' end) as reason,
    case when coalesce(nv, 0) < 4 or velocity is null then 0 when vd > 0 then (velocity - vm) / (vd * 1.4826) when vi > 0 then (velocity - vm) / (vi / 1.349) else 0 end::double as ztv,
    case when coalesce(na, 0) < 4 or acceleration is null then 0 when ad > 0 then (acceleration - am) / (ad * 1.4826) when ai > 0 then (acceleration - am) / (ai / 1.349) else 0 end::double as zta,
    case when velocity is null or pvm is null then 0 when pvd > 0 then (velocity - pvm) / (pvd * 1.4826) when pvi > 0 then (velocity - pvm) / (pvi / 1.349) else 0 end::double as zsv,
    case when acceleration is null or pam is null then 0 when pad > 0 then (acceleration - pam) / (pad * 1.4826) when pai > 0 then (acceleration - pam) / (pai / 1.349) else 0 end::double as zsa
  from states s left join pasts using (unit_id, step) left join peers using (step)),
scored as (
  select step, unit_id, case when reason is null then greatest(least(ztv, zsv), least(zta, zsa)) end as score, velocity, acceleration, n_samples, median_coherence, reason from z),
tiers as (
  select *, case when score is null then 'insufficient' when score >= 3 then 'watch' when score >= 2 then 'elevated' else 'quiet' end as tier from scored)"""
)


@query(
    "with "
    + SCORED
    + """
select step, unit_id, tier, round(score, 4) as score, round(velocity, 4) as velocity, round(acceleration, 2) as acceleration, n_samples, round(median_coherence, 6) as median_coherence, reason from tiers"""
)
def watch_tiers_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of every unit at every step, ordered as a report."""
    out = watch.score(states(spark, sf_dir), CONFIG)
    out = out.orderBy("step", F.desc_nulls_last("score"), "unit_id")
    return out.withColumns({"score": rounded("score", 4), "velocity": rounded("velocity", 4), "acceleration": rounded("acceleration", 2), "median_coherence": rounded("median_coherence")})


@query()
def watch_tiers_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after each step's own harmonic fit is removed."""
    known = units(spark, sf_dir)
    scaled = samples(spark, sf_dir).join(known.select("unit_id", "sens"), "unit_id").withColumn("v", F.col("v") / F.col("sens"))
    return watch.score(watch.unit_states(watch.deseasonalised(scaled, CONFIG), known, CONFIG), CONFIG)


@query(
    "with "
    + SCORED
    + """
select unit_id, step, tier, round(score, 4) as score, reason, (select round(max(t), 6) from samples where t <= 28) as max_input_t from tiers where step = 28 and unit_id % 3 = 0
union all select -1, 28, 'insufficient', null, 'unit_not_in_view', (select round(max(t), 6) from samples where t <= 28)"""
)
def watch_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every third unit, and of one that isn't there, on one day, from nothing later than that day."""
    known = units(spark, sf_dir)
    scaled = samples(spark, sf_dir).join(known.select("unit_id", "sens"), "unit_id").withColumn("v", F.col("v") / F.col("sens"))
    asked = known.where("unit_id % 3 = 0").select("unit_id").unionByName(spark.createDataFrame([(-1,)], "unit_id long"))
    out = watch.score_as_of(scaled, known, CONFIG, 28, asked)
    return out.select("unit_id", "step", "tier", rounded("score", 4).alias("score"), "reason", rounded("max_input_t").alias("max_input_t"))


@query("with " + SCORED + " select step, count(*) filter (where tier = 'watch') as n_watch, count(*) filter (where tier = 'elevated') as n_elevated, count(*) filter (where tier = 'quiet') as n_quiet, count(*) filter (where tier = 'insufficient') as n_insufficient, round(max(score), 4) as best_score from tiers group by step")
def step_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.step_counts(watch.score(states(spark, sf_dir), CONFIG)).withColumn("best_score", rounded("best_score", 4))


@query(
    "with "
    + SCORED
    + """
select unit_id, count(*) filter (where reason is null) as n_measurable,
  ['insufficient', 'quiet', 'elevated', 'watch'][max(case tier when 'watch' then 4 when 'elevated' then 3 when 'quiet' then 2 else 1 end)] as best_tier,
  min(step) filter (where tier = 'watch') as first_watch_step, count(distinct reason) as n_reasons from tiers group by unit_id"""
)
def unit_lead_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.unit_history(watch.score(states(spark, sf_dir), CONFIG))


@query(
    "with "
    + SCORED
    + """,
ever as (select unit_id, bool_or(reason is null) as ever, arg_max(coalesce(reason, 'observable'), step) as final from tiers group by unit_id)
select final as final_state, count(*) as n_units, count(*) filter (where ever) as n_ever from ever group by final"""
)
def observability_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by the reason at the last step, and how many were ever observable."""
    scored = watch.score(states(spark, sf_dir), CONFIG)
    ever = scored.groupBy("unit_id").agg(F.bool_or(F.col("reason").isNull()).alias("ever"), F.max_by(F.coalesce("reason", F.lit("observable")), "step").alias("final_state"))
    return ever.groupBy("final_state").agg(F.count("*").alias("n_units"), F.count_if("ever").alias("n_ever"))


@query(
    """
select user_id as unit_id, floor((epoch_us(ts) - 1704067200000000) / 86400000000.0::double)::bigint as day, count(*) as n_samples,
  round(case when count(*) filter (where cast(props->>'$.k' as double) >= 40) >= 2 then quantile_cont(case when cast(props->>'$.k' as double) >= 40 then value end, 0.5) end, 6) as median_value,
  round(avg(case when cast(props->>'$.k' as double) >= 40 then 0.0 else 1.0 end), 6) as lost_fraction, bool_or(cast(props->>'$.k' as double) > 0) as inside
from events group by all"""
)
def unit_daily_median_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over usable samples; null, not zero, below the least number of them."""
    usable = F.col("coh") >= 0.4
    rows = samples(spark, sf_dir).withColumn("day", F.floor("t"))
    return rows.groupBy("unit_id", "day").agg(
        F.count("*").alias("n_samples"),
        rounded(F.when(F.count_if(usable) >= 2, Q.linear(F.when(usable, F.col("v")), 0.5))).alias("median_value"),
        rounded(F.avg(F.when(usable, 0.0).otherwise(1.0))).alias("lost_fraction"),
        F.bool_or(F.col("coh") > 0).alias("inside"),
    )


@query(
    "with "
    + SAMPLES
    + """
select s.unit_id, p.step, round(case when count(v) >= 3 then 365.25 * regr_slope(v, t) end, 4) as slope
from samples s join steps p on s.t <= p.step and s.t > p.step - 7 group by all"""
)
def trailing_slope_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = watch.WatchConfig(span_days=7.0, first_step=10, last_step=30, every=1)
    dealt = watch.at_steps(samples(spark, sf_dir), week)
    slope = watch.trailing_slope(F.col("v"), F.col("t"), F.col("step") - 7, F.col("step"), 365.25)
    return dealt.groupBy("unit_id", "step").agg(rounded(slope, 4).alias("slope"))


@query(
    """
with daily as (select event_type, user_id, sum(value) as v from events group by all),
c as (select event_type, quantile_cont(v, 0.5) as m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as i from daily group by 1),
d as (select event_type, m, i, quantile_cont(abs(v - m), 0.5) as d from daily join c using (event_type) group by all)
select event_type, user_id, round(case when d > 0 then (v - m) / (d * 1.4826) when i > 0 then (v - m) / (i / 1.349) else 0 end, 6) as z from daily join d using (event_type)"""
)
def robust_z_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    c = daily.groupBy("event_type").agg(Q.linear("v", 0.5).alias("m"), Q.linear("v", 0.25).alias("q1"), Q.linear("v", 0.75).alias("q3"))
    d = daily.join(c, "event_type").groupBy("event_type").agg(F.percentile(F.abs(F.col("v") - F.col("m")), F.lit(0.5)).alias("mad"))
    scale = Q.robust_scale(F.col("mad"), F.col("q1"), F.col("q3"))
    return daily.join(c, "event_type").join(d, "event_type").select("event_type", "user_id", rounded(Q.robust_z(F.col("v"), F.col("m"), scale)).alias("z"))


@query(
    """
with b as (select least(5, floor(value / 80))::bigint as band, cast(props->>'$.k' as double) / 100 as coh from events)
select coalesce(band, -1)::bigint as band, count(*) as n, round(avg(coh), 6) as mean_coherence, round(avg(case when coh >= 0.4 then 1.0 else 0.0 end), 6) as usable
from b group by rollup (band) having count(*) >= 50"""
)
def coherence_bands_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands and a grand total; bands of fewer than 50 samples are left out."""
    band = F.least(F.lit(5), F.floor(F.col("v") / 80)).cast("long")
    out = samples(spark, sf_dir).withColumn("band", band).rollup("band").agg(F.count("*").alias("n"), rounded(F.avg("coh")).alias("mean_coherence"), rounded(F.avg(F.when(F.col("coh") >= 0.4, 1.0).otherwise(0.0))).alias("usable"))
    return out.where("n >= 50").withColumn("band", F.coalesce("band", F.lit(-1)).cast("long"))


@query(
    """
with t as (select unnest([20, 40, 60, 80]) as threshold), u as (
  select threshold, user_id, count(*) filter (where cast(props->>'$.k' as int) >= threshold) as n from events cross join t group by all)
select threshold, count(*) as n_units, count(*) filter (where n >= 5) as n_measurable from u group by threshold"""
)
def measurability_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each threshold the units with at least five samples at or above it; one pass over the samples."""
    limits = (20, 40, 60, 80)
    k = F.get_json_object("props", "$.k").cast("int")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(k >= x).alias(f"n{x}") for x in limits])
    rows = per.select(F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"n{x}").alias("n")) for x in limits])).alias("x")).select("x.*")
    return rows.groupBy("threshold").agg(F.count("*").alias("n_units"), F.count_if(F.col("n") >= 5).alias("n_measurable"))
