"""Mass estimates, window features, balance, designs and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import hazard, text
from moraine.functions import quantiles as Q
from moraine.operators import balance, catalog, contracts, force, windows
from moraine.plans.base import micros, query, rounded
from moraine.plans.hazard import NEAREST, ensemble_arrivals
from moraine.tables import table

DT = 2.0
FORCES = """
v as (select vec_id, embedding as e from embeddings where len(embedding) >= 63),
f as (select vec_id, i, e[i + 1]::double * 1e10 as up, e[i + 22]::double * 1e10 as north, e[i + 43]::double * 1e10 as east from v, (select unnest(range(21)) as i)),
r as (select *, 2.0::double * sum(up) over w as su, 2.0::double * sum(north) over w as sn, 2.0::double * sum(east) over w as se from f window w as (partition by vec_id order by i rows unbounded preceding)),
m as (select *, sqrt(up * up + north * north + east * east) as m, sqrt(north * north + east * east) as h, sqrt(su * su + sn * sn + se * se) as r from r),
p as (select *, max(m) over (partition by vec_id) as peak from m),
s as (select vec_id, max(m) as peak_force, arg_min(i, (-m, i)) as peak_index, max(r) as impulse, arg_min(i, (-r, i)) as impulse_index, min(i) filter (where m >= 0.05 * peak) as onset_index, max(i) filter (where m >= 0.05 * peak) as last,
    (degrees(atan2(sum(east * m * m), sum(north * m * m))) + 360) % 360 as azimuth, degrees(atan2(abs(arg_min(up, (-h, i))), arg_min(h, (-h, i)))) as path_angle from p group by vec_id),
g as (select *, (last - onset_index) * 2.0::double as duration_s, greatest(impulse_index - onset_index, 1) * 2.0::double as acceleration_s from s)"""


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as forces of 21 steps in three components."""
    e = lambda i, k: F.get("embedding", i + 21 * k).cast("double") * 1e10
    steps = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(e(i, 0).alias("up"), e(i, 1).alias("north"), e(i, 2).alias("east")))
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 63).select("vec_id", steps.alias("force"))


@query(f"with {FORCES} select vec_id, round(peak_force, 1) as peak_force, peak_index, round(impulse, 1) as impulse, impulse_index, onset_index, duration_s, acceleration_s, round(azimuth, 6) as azimuth, round(path_angle, 6) as path_angle from g")
def force_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = force.summarise(histories(spark, sf_dir), "vec_id", "force", DT)
    return out.withColumns({c: rounded(c, 1) for c in ("peak_force", "impulse")} | {c: rounded(c) for c in ("azimuth", "path_angle")})


@query(
    f"""
with {FORCES},
a as (select vec_id, peak_force, impulse / acceleration_s as rate, path_angle, case when vec_id % 3 = 0 then 10 + vec_id % 50 end::double as terrain, case when vec_id % 3 = 1 then 500.0::double end as drop, case when vec_id % 3 = 1 then 1000.0::double + vec_id end as runout from g),
b as (select *, greatest(8, least(55, coalesce(terrain, degrees(atan2(drop, runout)), path_angle))) as angle, case when terrain is not null then 'dem_trajectory' when drop is not null then 'published' else 'force_history' end as basis, greatest(8, least(55, path_angle)) as own from a),
k as (select *, 0.2::double + 0.6::double * k / 32.0::double as phi from b, (select unnest(range(33)) as k)),
q as (select vec_id, any_value(angle) as angle, any_value(basis) as basis, quantile_cont(peak_force / greatest(9.81::double * sin(radians(angle)) * (1 - phi), 0.05), [0.05, 0.5, 0.95]) as a, quantile_cont(rate / greatest(9.81::double * sin(radians(own)) * (1 - phi), 0.05), [0.05, 0.5, 0.95]) as b from k group by vec_id)
select vec_id, basis, round(angle, 6) as angle, round(log10(a[1]), 6) as force_p05, round(log10(a[3]), 6) as force_p95, round(log10(b[1]), 6) as impulse_p05, round(log10(b[3]), 6) as impulse_p95,
  round(log10(least(a[1], b[1])), 6) as p05, round(log10(greatest(least(a[1], b[1]) * 1.0000001, least(greatest(a[3], b[3]) * 0.9999999, sqrt(a[2] * b[2])))), 6) as p50, round(log10(greatest(a[3], b[3])), 6) as p95, round(log10(a[2] / b[2]), 6) as ratio from q"""
)
def mass_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two estimates of each history's mass and their union, as logarithms; the path angle from terrain, a publication or the force."""
    k = F.col("vec_id")
    out = force.estimates(force.summarise(histories(spark, sf_dir), "vec_id", "force", DT), F.when(k % 3 == 0, (10 + k % 50).cast("double")), F.when(k % 3 == 1, 500.0), F.when(k % 3 == 1, 1000.0 + k))
    return out.select("vec_id", "basis", rounded("angle").alias("angle"), *[rounded(F.log10(c)).alias(c) for c in ("force_p05", "force_p95", "impulse_p05", "impulse_p95", "p05", "p50", "p95", "ratio")])


@query()
def terrain_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mass at which each history's path and a terrain profile agree; a bisection isn't SQL."""
    ends = force.unit_displacement(histories(spark, sf_dir), "vec_id", "force", DT)
    x = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: i * F.lit(100.0))
    z = F.transform(x, lambda d: 2000 * (1 - F.exp(-d / (800 + F.col("vec_id") % 9 * 100))))
    return ends.withColumn("mass", force.mass_from_terrain()("drop", "runout", x, z))


@query(
    """
with d as (select p_brand, (p_partkey * 37 % 120 + 300)::double % 360 as a from part),
m as (select p_brand, (degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))) + 360) % 360 as mean from d group by p_brand),
o as (select p_brand, mean, (a - mean + 180 + 720) % 360 - 180 as off from d join m using (p_brand))
select p_brand, round(mean + quantile_cont(off, 0.05), 6) as p5, round(mean + quantile_cont(off, 0.5), 6) as p50, round(mean + quantile_cont(off, 0.95), 6) as p95 from o group by p_brand, mean"""
)
def azimuth_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.pmod((F.col("p_partkey") * 37 % 120 + 300).cast("double"), F.lit(360.0)).alias("a"))
    return force.circular_percentiles(rows, ["p_brand"], "a").withColumns({c: rounded(c) for c in ("p5", "p50", "p95")})


@query(
    """
with r as (select vec_id, label, 1 / sqrt(nullif(list_sum([x::double * x for x in embedding]), 0) / len(embedding)) as w from embeddings where embedding is not null)
select vec_id, label, round(coalesce(w, 0) * count(*) over g / sum(w) over g, 6) as weight from r window g as (partition by label)"""
)
def station_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = force.station_weights(table(spark, sf_dir, "embeddings").where("embedding is not null"), "label", "embedding")
    return rows.select("vec_id", "label", rounded("weight").alias("weight"))


@query(
    """
with c as (select l_orderkey % 400 as event, l_suppkey as station, (l_partkey % 200) / 12.0::double as distance, case when l_linenumber = 7 then l_extendedprice * 100 else l_quantity end as amplitude, (l_suppkey * 47 % 360)::double as azimuth from lineitem),
m as (select event, median(amplitude) filter (where distance between 0.5 and 15 and amplitude > 0) as m from c group by event),
d as (select c.*, case when not distance between 0.5 and 15 then 'distance' when amplitude > 20 * m then 'glitch' end as dropped from c join m using (event)),
s as (select event, count(*) filter (where dropped = 'distance') as n_distance, count(*) filter (where dropped = 'glitch') as n_glitch, count(distinct station) filter (where dropped is null) as n_stations from d group by event),
u as (select distinct event, station, azimuth from d where dropped is null),
w as (select event, coalesce(lead(azimuth) over (partition by event order by azimuth, station), min(azimuth) over (partition by event) + 360) - azimuth as step from u),
x as (select event, case when count(*) < 2 then 360 else max(step) end as gap from w group by event)
select event, n_distance, n_glitch, n_stations, case when n_stations < 5 then 'only ' || n_stations || ' station(s) contributed, below the minimum of 5' when gap > 200 then 'azimuthal gap ' || printf('%.0f', gap) || ' deg exceeds the limit of 200 deg' end as refusal from s left join x using (event)"""
)
def channel_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels dropped for distance or as glitches, and events that their geometry refuses."""
    k = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 400).alias("event"), k.alias("station"), ((F.col("l_partkey") % 200) / 12.0).alias("distance_deg"), F.when(F.col("l_linenumber") == 7, F.col("l_extendedprice") * 100).otherwise(F.col("l_quantity")).alias("amplitude"), (k * 47 % 360).cast("double").alias("azimuth"))
    used, why = F.col("dropped").isNull(), F.col("dropped")
    channels = force.usable_channels(rows, "event")
    out = channels.groupBy("event").agg(F.count_if(why == "distance").alias("n_distance"), F.count_if(why == "glitch").alias("n_glitch"), F.count_distinct(F.when(used, F.col("station"))).alias("n_stations"))
    gaps = catalog.azimuthal_gap(channels.where(used).select("event", "station", "azimuth").distinct(), "event").select("event", "gap")
    return out.join(gaps, "event", "left").select("event", "n_distance", "n_glitch", "n_stations", force.refusal(F.col("n_stations"), F.col("gap")).alias("refusal"))


@query(
    """
with g as (select s_suppkey as id, -60 + s_suppkey % 120 as lat, s_suppkey % 360 - 180 as lon, i, j, d from supplier, (select unnest(range(-2, 3)) as i), (select unnest(range(-2, 3)) as j), (values (0.0::double), (5000.0::double)) v(d)),
n as (select id, lat + i * 10 / (pi() * 6371.0088::double / 180) as tlat, lon + j * 10 / (pi() * 6371.0088::double / 180 * greatest(cos(radians(lat)), 1e-6)) as tlon, d, 0.9::double - (abs(i - 1) + abs(j)) / 150.0::double - d / 1e6 as vr, sqrt((i - 1) * (i - 1) + j * j) * 10 as away from g)
select id, count(*) as n_nodes, round(max(away), 6) as radius, round(max(tlat), 6) as north, round(max(tlon), 6) as east from (select *, max(vr) over (partition by id) as best from n) where vr >= best - 0.02 group by id"""
)
def trial_grid_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial locations about each source, and how far those reach that fit nearly as well as the best."""
    k = F.col("s_suppkey")
    nodes = force.trial_grid(table(spark, sf_dir, "supplier").select(k.alias("id"), (-60 + k % 120).cast("double").alias("latitude"), (k % 360 - 180).cast("double").alias("longitude")), 10.0, 5, (0.0, 5000.0))
    i, j = F.col("i") - 1, F.col("j")
    nodes = nodes.withColumns({"vr": 0.9 - (F.abs(i) + F.abs(j)) / 150.0 - F.col("depth_m") / 1e6, "away": F.sqrt(i * i + j * j) * 10})
    near = nodes.withColumn("_b", F.max("vr").over(Window.partitionBy("id"))).where("vr >= _b - 0.02").groupBy("id").agg(rounded(F.max("trial_latitude")).alias("north"), rounded(F.max("trial_longitude")).alias("east"))
    return force.uncertainty_radius(nodes, "id", "vr", "away").withColumn("radius", rounded("radius")).join(near, "id").select("id", "n_nodes", "radius", "north", "east")


@query(
    """
with q as (select l_suppkey as station, quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) as q, count(*) as n from (select l_suppkey, case when l_suppkey % 3 = 0 then 1000 else l_extendedprice end as l_extendedprice from lineitem) group by 1)
select station, n, round(case when q[1] < q[2] then q[1] else q[2] / 1.5::double end, 6) as low, round(q[2], 6) as mid, round(case when q[3] > q[2] then q[3] else q[2] * 1.5::double end, 6) as high from q"""
)
def mass_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5/50/95 spread; only an end that isn't beyond the middle is moved."""
    x = F.when(F.col("l_suppkey") % 3 == 0, 1000.0).otherwise(F.col("l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("station"), x.alias("x")).groupBy("station")
    ends = rows.agg(F.count("*").alias("n"), *[Q.linear("x", q).alias(f"q{k}") for k, q in enumerate((0.05, 0.5, 0.95))])
    return ends.select("station", "n", *[rounded(c).alias(n) for c, n in zip(contracts.spread(*map(F.col, ("q0", "q1", "q2"))), ("low", "mid", "high"))])


@query()
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """79 numbers of each window of four receivers. Spectra aren't SQL."""
    e = F.col("embedding")
    slots = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.floor(F.col("vec_id") / 4).alias("window"), e.alias("z"), F.when(F.col("vec_id") % 3 > 0, F.reverse(e)).alias("n"), F.transform(e, lambda x: x * x).alias("e"))
    return windows.window_features(slots, "window", windows.Bands(1.0, (0.02, 0.1), (0.0, 0.02), (0.25, 0.5), (0.1, 0.25), 3.0, 16.0))


# Balance of receivers

INDEX = """
w as (select l_orderkey * 10 + l_linenumber as entry, l_linenumber = 1 as positive, case when l_linenumber = 1 then 'slide' when l_linenumber < 6 then 'tectonic' else 'noise' end as label,
    case when l_linenumber > 1 then case when l_orderkey % 9 = 0 then -1 else l_orderkey * 10 + 1 end end as matched, (l_quantity::bigint % 13) as n_stations, [(l_suppkey + i * l_linenumber) % 20 for i in range(l_quantity::bigint % 13)] as keys from lineitem),
q as (select *, case when positive then entry else matched end as g from w),
b as (select q.*, x.quota, coalesce(least(x.quota, n_stations), n_stations) as keep, not positive and x.quota is null as orphan from q left join (select g, min(n_stations) as quota from q group by g having bool_or(positive) and g is not null) x using (g))"""


def receiver_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line, n = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long") % 13
    keys = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: (F.col("l_suppkey") + i * line) % 20)).otherwise(F.array().cast("array<long>"))
    matched = F.when(line > 1, F.when(k % 9 == 0, -1).otherwise(k * 10 + 1))
    return table(spark, sf_dir, "lineitem").select((k * 10 + line).alias("entry"), (line == 1).alias("positive"), F.when(line == 1, "slide").when(line < 6, "tectonic").otherwise("noise").alias("label"), matched.alias("matched"), n.cast("int").alias("n_stations"), keys.alias("station_keys"))


AUC = "(select round((sum(rk) filter (where positive) - count(*) filter (where positive) * (count(*) filter (where positive) + 1) / 2.0) / (count(*) filter (where positive) * count(*) filter (where not positive)), 9)::double from (select positive, rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0 as rk from b where (positive or label = 'tectonic') {more}))"


@query(
    f"""
with {INDEX}, l as (select g, keys[1 : quota] as theirs from b where positive and quota > 0)
select count(distinct case when quota is not null then g end) as n_groups, count(quota) as n_bound, count(*) filter (where positive and quota = 0) as n_emptied, sum(case when quota is not null then n_stations - keep end)::bigint as n_dropped, count(*) filter (where orphan) as n_orphans,
  {AUC.format(x="n_stations", more="")} as auc_before, {AUC.format(x="keep", more="")} as auc_after, {AUC.format(x="keep", more="and not orphan")} as auc_without_orphans,
  (select round(avg(len(list_intersect(list_distinct(keys[1 : quota]), list_distinct(theirs))) / quota::double), 9) from b join l using (g) where not positive and quota > 0) as agreement from b"""
)
def receiver_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What equal receiver counts within groups cost and buy."""
    out = balance.report(receiver_index(spark, sf_dir))
    return out.withColumns({c: rounded(c, 9) for c in ("auc_before", "auc_after", "auc_without_orphans", "agreement")})


@query(f"with {INDEX} select label, round(avg(n_stations), 9) as before, round(avg(keep), 9) as after from b group by label")
def receiver_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.means(receiver_index(spark, sf_dir)).withColumns({c: rounded(c, 9) for c in ("before", "after")})


@query("with s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as d from lineitem) select l_linenumber as line, round(sum((l_quantity - m) / d), 4) as total, 0.0::double as still, count(*) as n from lineitem, s group by 1")
def standardised_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns on their population's scale; one that doesn't vary stays at 0."""
    rows = balance.standardised(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", F.lit(7.0).alias("flat")), ["l_quantity", "flat"])
    return rows.groupBy(F.col("l_linenumber").alias("line")).agg(rounded(F.sum("l_quantity"), 4).alias("total"), F.max("flat").alias("still"), F.count("*").alias("n"))


@query()
def hypercube_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded Latin hypercube over suppliers, in three dimensions, with their split by run. The order is a hash of Spark's."""
    rows = balance.latin_hypercube(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 3, 20260903)
    return balance.split_by_run(rows, "s_suppkey", 20260903)


@query(
    """
with recursive x as (
  select (n_chars % 101) / 50.0::double - 1 as v, count(*) filter (where quality = 1) as p, count(*) filter (where quality is distinct from 1) as n from labels join documents using (doc_id) group by 1),
t as (select (sum(p) + sum(n))::double as total, (sum(p) + 1) / (sum(p) + 2)::double as high, 1 / (sum(n) + 2)::double as low from x),
g as (
  select 0 as i, 1.0::double as a, 0.0::double as b
  union all
  select i + 1, a - 0.5::double * sum(w * v) / any_value(total), b - 0.5::double * sum(w) / any_value(total)
  from (select i, a, b, v, total, p * (1 / (1 + exp(-(v * a + b))) - high) + n * (1 / (1 + exp(-(v * a + b))) - low) as w from g, x, t where i < 200) s group by i, a, b)
select round(a, 6) as slope, round(b, 6) as intercept from g where i = 200"""
)
def platt_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and intercept that turn scores into probabilities, by 200 gradient steps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 101) / 50.0 - 1).alias("score"))
    slope, intercept = balance.sigmoid(table(spark, sf_dir, "labels").join(docs, "doc_id"), "score", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")


# Forecasts and alerts

FORECAST = """
with a as (select user_id as forecast, event_type as transect, event_id, case when event_id % 3 > 0 then value / 80 end as stage, cast(props->>'$.k' as int) * 9.0::double as arrival, ts from events),
f as (select forecast, max(stage) as stage, min(arrival) as arrival, max(ts) as ts, count(distinct transect) as n_transects from a group by forecast)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals of each forecast at its transects: high end of the stage if one was modelled, low end of the arrival in minutes."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("forecast"), F.col("event_type").alias("transect"), F.when(F.col("event_id") % 3 > 0, F.col("value") / 80).alias("stage"), (k * F.lit(9.0)).alias("arrival"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    FORECAST
    + """
select translate('forecast ' || forecast, ' ,<&', '----') || '-' || strftime(ts, '%Y%m%dT%H%M%S') as identifier, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as sent,
  case when stage >= 5 then 'Extreme' when stage >= 2 then 'Severe' when stage >= 0.5 then 'Moderate' when stage >= 0 then 'Minor' else 'Unknown' end as severity,
  case when arrival is null then 'Unknown' when arrival <= 30 then 'Immediate' when arrival <= 180 then 'Expected' else 'Future' end as urgency, 'area of forecast ' || forecast || ': modelled to reach ' || n_transects || ' transect(s)' as area,
  strftime(ts + interval 6 hour, '%Y-%m-%dT%H:%M:%S') || '+00:00' as expires, forecast from f"""
)
def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert a forecast: severity by its largest stage, urgency by its earliest arrival."""
    f = forecasts(spark, sf_dir).groupBy("forecast").agg(F.max("stage").alias("stage"), F.min("arrival").alias("arrival"), F.max("ts").alias("ts"), F.count_distinct("transect").alias("n"))
    name = F.concat_ws(" ", F.lit("forecast"), "forecast")
    area = F.concat(F.lit("area of "), name, F.lit(": modelled to reach "), F.col("n").cast("string"), F.lit(" transect(s)"))
    return f.select(text.identifier(name, F.col("ts")).alias("identifier"), text.stamp(F.col("ts")).alias("sent"), hazard.severity(F.col("stage")).alias("severity"), hazard.urgency(F.col("arrival")).alias("urgency"), area.alias("area"), text.stamp(F.col("ts") + F.expr("interval 6 hours")).alias("expires"), "forecast")


@query()
def alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moraine.streaming.alerts import alert_xml

    return alert_xml(alert_messages(spark, sf_dir), "monitor@example.org")


@query(
    """
select 'detection-' || user_id || '-' || event_id || '-' || strftime(ts, '%Y%m%dT%H%M%S') as identifier, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as sent, 'Unknown' as severity, 'Unknown' as urgency, 'Unknown' as certainty, strftime(ts + interval 1 hour, '%Y-%m-%dT%H:%M:%S') || '+00:00' as expires
from events where event_type = 'error'"""
)
def detection_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for a detection alone: nothing is known of severity, urgency or certainty, and no area is named."""
    ts = F.col("ts").cast("timestamp_ntz")
    key = F.concat_ws("-", F.lit("detection"), "user_id", "event_id")
    unknown = [F.lit("Unknown").alias(n) for n in ("severity", "urgency", "certainty")]
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(text.identifier(key, ts).alias("identifier"), text.stamp(ts).alias("sent"), *unknown, text.stamp(ts + F.expr("interval 1 hour")).alias("expires"))


DELAY = """
delays as (select r_regionkey as event, 153.3::double as detection_s, case when r_regionkey % 2 = 0 then 33.8::double end as inversion_s, 0.00128::double as surrogate_s, 30.0::double as dissemination_s from region),
totals as (select event, case when inversion_s is null then null else detection_s + inversion_s + surrogate_s + dissemination_s end as known from delays)"""


@query(
    NEAREST
    + f""", {DELAY},
s as (select transect, count(*) as n, count(arrival) as reach, quantile_cont(arrival, 0.05) as p5, quantile_cont(arrival, 0.95) as p95 from arr group by transect)
select event, transect, reach as n_reach, round(p5, 6) as arrival_low, round(p95, 6) as arrival_high, round(p5 - known / 60, 6) as lead_low, round(p95 - known / 60, 6) as lead_high from s, totals where reach > 0"""
)
def prior_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ensemble's arrivals less the delay until an alert, for every event; no lead time where a part of the delay is unknown, no row for a transect that isn't reached."""
    k = F.col("r_regionkey")
    delays = table(spark, sf_dir, "region").select(k.alias("event"), F.lit(153.3).alias("detection_s"), F.when(k % 2 == 0, 33.8).alias("inversion_s"), F.lit(0.00128).alias("surrogate_s"), F.lit(30.0).alias("dissemination_s"))
    total = hazard.issue_delay_s(*map(F.col, ("detection_s", "inversion_s", "surrogate_s", "dissemination_s")))
    stats = ensemble_arrivals(spark, sf_dir).where("n_reach > 0")
    rows = stats.crossJoin(F.broadcast(delays.select("event", total.alias("delay"))))  # five events
    return rows.select("event", "transect", "n_reach", F.col("p5").alias("arrival_low"), F.col("p95").alias("arrival_high"), rounded(F.col("p5") - F.col("delay") / 60).alias("lead_low"), rounded(F.col("p95") - F.col("delay") / 60).alias("lead_high"))


@query(
    """
with x as (select event_id, epoch_us(ts) as origin, (value / 3) as a, (value / 4) as b, case when event_id % 2 = 0 then value / 3.5::double end as best, epoch_us(ts) + (event_id % 200) * 60000000 as sent from events)
select event_id, round(least(a, b) - (sent - origin) / 6e7::double, 6) as low, round(greatest(a, b) - (sent - origin) / 6e7::double, 6) as high, round(best - (sent - origin) / 6e7::double, 6) as best from x"""
)
def delivered_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes from an alert to the arrival; negative if the flow was first."""
    at, v = micros("ts"), F.col("value")
    low, high, best = hazard.delivered_lead((v / 3, v / 4, F.when(F.col("event_id") % 2 == 0, v / 3.5)), ((at + (F.col("event_id") % 200) * 60_000_000) - at) / 6e7)
    return table(spark, sf_dir, "events").select("event_id", rounded(low).alias("low"), rounded(high).alias("high"), rounded(best).alias("best"))


@query("select p_partkey as id, round(ln(greatest(p_retailprice, 1e-12)), 6) as volume, p_size / 50.0::double as ice, round(ln(greatest(p_size / 100.0::double, 1e-12)), 6) as mu, case when p_partkey % 2 = 0 then round(100 / 3.0::double + 600 - 60, 6) else round(100 / 3.0::double + 180 - 60, 6) end as floor_s from part")
def parameter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design parameters on the scales they were sampled on, and the earliest time that a mode of detection could decide."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_retailprice").alias("volume"), (F.col("p_size") / 50.0).alias("ice"), (F.col("p_size") / 100.0).alias("mu"), F.when(k % 2 == 0, 600.0).otherwise(180.0).alias("record"))
    return rows.select("id", rounded(hazard.log_parameter(F.col("volume"))).alias("volume"), "ice", rounded(hazard.log_parameter(F.col("mu"))).alias("mu"), rounded(hazard.detection_floor_s(F.col("record"))).alias("floor_s"))
