"""Scenes and layers: selection, band arithmetic, class statistics, fallbacks, overlaps, tiles, footprints and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators import scenes
from moraine.plans.base import micros, query, rounded
from moraine.plans.rules import LEDGER, ledger_rows
from moraine.tables import table


@query(f"with r as ({LEDGER}) select status, count(*) filter (where status in ('fetched', 'synthetic')) as n_usable, count(*) filter (where id % 3 = 1 and path is not null and (status = 'fetched' and provenance = 'real' and starts_with(path, 'data/raw/') or status = 'synthetic' and provenance = 'synthetic' and starts_with(path, 'tests/fixtures/synthetic/'))) as n_contributing from r group by status")
def contributing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with bytes, and those of one area that may give pixels."""
    rows = ledger_rows(spark, sf_dir).withColumn("aoi_id", F.col("id") % 3)
    return rows.groupBy("status").agg(F.count_if(scenes.usable()).alias("n_usable"), F.count_if(scenes.contributing(F.lit(1), "data/raw/")).alias("n_contributing"))


@query(
    """
with c as (select p_partkey as id, 'NISAR_L2_' || ['GCOV', 'RSLC', 'ORBIT', 'GUNW'][p_partkey % 4 + 1] || '_' || case when p_partkey % 3 = 0 then 'BETA' when p_partkey % 3 = 1 then 'PROVISIONAL' else 'FINAL' end || '_V1' as name, case p_partkey % 5 when 0 then 'X05' when 1 then 'p10' when 2 then '' when 3 then 'Z' end as code from part),
l as (select id, code, case when p_l in ('GCOV', 'RSLC', 'GUNW') and m in ('BETA', 'PROVISIONAL') then lower(m) else 'unknown' end as level from (select id, code, split_part(name, '_', 3) as p_l, split_part(name, '_', 4) as m from c))
select id, case when level <> 'unknown' and (upper(code[1:1]) = 'X' and level <> 'beta' or upper(code[1:1]) = 'P' and level <> 'provisional') then 'unknown' else level end as level from l"""
)
def collection_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    level = F.element_at(F.array(*map(F.lit, ("GCOV", "RSLC", "ORBIT", "GUNW"))), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("NISAR_L2_"), level, F.lit("_"), F.when(k % 3 == 0, "BETA").when(k % 3 == 1, "PROVISIONAL").otherwise("FINAL"), F.lit("_V1"))
    code = F.when(k % 5 == 0, "X05").when(k % 5 == 1, "p10").when(k % 5 == 2, "").when(k % 5 == 3, "Z")
    return table(spark, sf_dir, "part").select(k.alias("id"), scenes.collection_level(name, code).alias("level"))


CELLS = "c as (select l_orderkey % 300 as scene, case when l_orderkey % 300 < 5 then 0 else l_partkey % 13 end as class, case when l_linenumber % 5 = 0 then 0 else l_quantity end as b03, case when l_suppkey % 6 = 0 then 0 else l_suppkey / 2.0::double end as b11, l_linenumber as line, l_partkey as cell from lineitem)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = F.col("l_orderkey") % 300
    return table(spark, sf_dir, "lineitem").select(scene.alias("scene"), F.when(scene < 5, 0).otherwise(F.col("l_partkey") % 13).alias("class"), F.when(F.col("l_linenumber") % 5 == 0, 0.0).otherwise(F.col("l_quantity")).alias("b03"), F.when(F.col("l_suppkey") % 6 == 0, 0.0).otherwise(F.col("l_suppkey") / 2.0).alias("b11"))


@query(f"with {CELLS} select scene, round(count(*) filter (where class in (3, 8, 9, 10, 11)) / nullif(count(*) filter (where class <> 0), 0)::double, 9) as cloud, round(avg(case when b03 > 0 and b11 > 0 then (b03 - b11) / (b03 + b11) end), 9) as snow, count(*) as n from c group by scene")
def scene_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cloud, shadow and snow among valid cells (null where none is valid), and mean snow index."""
    rows = _cells(spark, sf_dir).groupBy("scene").agg(scenes.cloud_fraction(F.col("class")).alias("cloud"), F.avg(scenes.snow_index(F.col("b03"), F.col("b11"))).alias("snow"), F.count("*").alias("n"))
    return rows.withColumns({c: rounded(c, 9) for c in ("cloud", "snow")})


@query(
    f"with {CELLS} select ['no_data', 'saturated_or_defective', 'dark_area', 'cloud_shadow', 'vegetation', 'not_vegetated', 'water', 'unclassified', 'cloud_medium_probability', 'cloud_high_probability', 'thin_cirrus', 'snow_or_ice', 'class_12'][class + 1] as name, count(*) as n from c group by class"
)
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n")).select(scenes.class_name(F.col("class")).alias("name"), "n")


@query(
    """
with f as (select l_orderkey % 2000 as pair, case when l_linenumber < 4 then 'corr' when l_linenumber < 6 then 'los' end as kind, l_orderkey * 10 + l_linenumber as entry, l_suppkey % 4 > 0 as real from lineitem),
p as (select pair, max(entry) filter (where kind = 'corr') as corr, max(entry) filter (where kind = 'los') as los, bool_and(real) as real from f group by pair)
select pair, corr, los, real from p where corr is not null and (real or not (select bool_or(real) from p where corr is not null))"""
)
def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that have a coherence file; synthetic ones count only where there is no real one at all."""
    line, entry = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    files = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2000).alias("pair"), F.when(line < 4, "corr").when(line < 6, "los").alias("kind"), entry.alias("entry"), entry.alias("place"), (F.col("l_suppkey") % 4 > 0).alias("real"))
    return scenes.complete_pairs(files)


@query(
    """
with t as (select distinct (epoch_us(o_orderdate) // 1000000)::bigint as t from orders),
s as (select case event_type when 'click' then 1 when 'view' then 2 else 3 end as rank, (epoch_us(ts) // 1000000)::bigint - 800000000 + event_id % 977 * 86400 as step, min(value) as value from events group by 1, 2),
n as (select t, arg_min({'rank': rank, 'step': step, 'value': value}, (rank, abs(step - t), step)) as b from t join s on step between t - 7200 and t + 7200 group by t)
select t, b.rank as rank, b.step as step, b.value as value, b is not null as valid from t left join n using (t)"""
)
def layer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's step in the first dataset that has one within two hours; else none, and not valid."""
    kind = F.col("event_type")
    at = F.floor(micros("ts") / 1_000_000) - 800_000_000 + F.col("event_id") % 977 * 86400
    steps = table(spark, sf_dir, "events").select(F.when(kind == "click", 1).when(kind == "view", 2).otherwise(3).alias("rank"), at.alias("t"), "value").groupBy("rank", "t").agg(F.min("value").alias("value"))
    targets = table(spark, sf_dir, "orders").select(F.floor(micros("o_orderdate") / 1_000_000).alias("t")).distinct()
    return scenes.fallback_steps(targets, steps, 7200)


@query(
    """
with b as (select s_suppkey as id, (s_suppkey * 7 % 350 - 175)::double + case when s_suppkey % 4 = 0 then 0.5 else 0 end as w, (s_suppkey * 3 % 170 - 85)::double as s, s_suppkey % 3 as dw, s_suppkey % 2 + 0.25::double as dh from supplier),
i as (select id, unnest(range(greatest(floor(s - 0.5 / 3600)::bigint, -90), least(floor(s + dh - 0.5 / 3600)::bigint, 89) + 1)) as lat, floor(w + 0.5 / 3600)::bigint as lo, floor(w + dw + 0.5 / 3600)::bigint as hi from b)
select id, lat::int as lat, unnest(range(lo, hi + 1))::int as lon from i"""
)
def elevation_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that each box needs; an edge on a whole degree doesn't reach the next one."""
    k = F.col("s_suppkey")
    w, s = (k * 7 % 350 - 175).cast("double") + F.when(k % 4 == 0, 0.5).otherwise(0.0), (k * 3 % 170 - 85).cast("double")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.explode(scenes.tiles(w, s, w + k % 3, s + k % 2 + 0.25)).alias("t")).select("id", "t.*")


@query(
    """
with w as (select n_nationkey as id, (n_nationkey * 100)::bigint as a, (n_nationkey * 100 + n_nationkey * 37 % 900)::bigint as b from nation),
s as (select id, a, b, unnest(range(a, b, 180)) as start from w), g as (select id, start, least(start + 180, b) as stop from s),
f as (select id, start, case when o_orderkey % 50 > 0 then 'S' || o_orderkey % 40 end as name, o_orderkey as k from g join orders on o_orderkey between start and stop)
select id || ':' || name as scene, max((start, k)).k as entry from (select id, name, {'start': start, 'k': k} as x, start, k from f where name is not null) group by id, name""".replace("max((start, k)).k", "arg_max(k, (start, k))")
)
def sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long search in slices; a scene that two slices return counts once, as the last returned it."""
    k = F.col("n_nationkey")
    a = (k * 100).cast("long")
    windows = table(spark, sf_dir, "nation").select(k.alias("id"), F.explode(scenes.slices(a, a + (k * 37 % 900).cast("long"), 180)).alias("s")).select("id", "s.*")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 50 > 0, F.concat(F.lit("S"), (F.col("o_orderkey") % 40).cast("string"))).alias("name"))
    starts = windows.withColumn("k", F.explode(F.sequence("start", "stop")))  # at most a slice's length
    found = starts.join(orders, "k").select(F.concat_ws(":", "id", F.when(F.col("name").isNotNull(), F.col("name"))).alias("scene"), F.col("name"), "start", "k")
    return scenes.search_in_slices(found.where("name is not null"), "scene", F.struct("start", "k")).select("scene", F.col("k").alias("entry"))


OVERLAP = """
u as (select p_partkey as unit, (p_partkey * 13 % 997)::double as x0, (p_partkey * 29 % 991)::double as y0, p_size::double as w from part),
z as (select s_suppkey as zone, (s_suppkey * 17 % 900)::double as x0, (s_suppkey * 31 % 900)::double as y0, 40 + s_suppkey % 60::double as w from supplier),
o as (select zone, unit, greatest(0, least(u.x0 + u.w, z.x0 + z.w) - greatest(u.x0, z.x0)) * greatest(0, least(u.y0 + u.w, z.y0 + z.w) - greatest(u.y0, z.y0)) as overlap from u join z on u.x0 <= z.x0 + z.w and z.x0 <= u.x0 + u.w and u.y0 <= z.y0 + z.w and z.y0 <= u.y0 + u.w)"""


def _units_and_zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    x, y, w = (k * 13 % 997).cast("double"), (k * 29 % 991).cast("double"), F.col("p_size").cast("double")
    units = table(spark, sf_dir, "part").select(k.alias("unit"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + w).alias("y1"))
    x, y, w = (s * 17 % 900).cast("double"), (s * 31 % 900).cast("double"), (40 + s % 60).cast("double")
    zones = table(spark, sf_dir, "supplier").select(s.alias("zone"), x.alias("zx0"), y.alias("zy0"), (x + w).alias("zx1"), (y + w).alias("zy1"))
    return units, zones


@query(f"with {OVERLAP} select zone, unit, overlap from o")
def zone_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.zone_units(*_units_and_zones(spark, sf_dir), 100.0)


@query(f"with {OVERLAP}, r as (select *, row_number() over (partition by zone order by overlap desc, unit) as place, count(*) over (partition by zone) as n from o) select zone, place::int as place, unit, overlap, n from r where place <= 6")
def failed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit with the greatest share of each zone, and five runners-up."""
    return scenes.failed_unit(*_units_and_zones(spark, sf_dir), 100.0)


@query(
    """
with b as (select o_custkey % 20 as track, l_linenumber as burst, year(o_orderdate) as pass, (l_linenumber * 7 % 5)::double as overlap from lineitem join orders on l_orderkey = o_orderkey),
h as (select track, burst, count(distinct pass) as n_passes, max(overlap) as overlap from b group by all), p as (select track, count(distinct pass) as n from b group by track),
r as (select h.*, row_number() over (partition by track order by overlap desc, burst) as r from h join p using (track) where n_passes >= 0.9::double * n and overlap > 0)
select track, burst, n_passes, overlap from r where r <= 3"""
)
def stable_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select((F.col("o_custkey") % 20).alias("track"), F.col("l_linenumber").alias("burst"), F.year("o_orderdate").alias("pass"), (F.col("l_linenumber") * 7 % 5).cast("double").alias("overlap"))
    return scenes.stable_bursts(rows, 3).select("track", "burst", "n_passes", "overlap")


@query(
    """
select event_type as layer, avg((event_id % 9 > 0 and event_id % 8 > 0)::int::double) as finite_fraction, count(*) as n_cells, (select count(*) from (select distinct event_type, date_trunc('day', ts) as d from events) x where x.event_type = e.event_type and day(d) % 3 > 0) as n_times_valid from events e group by event_type"""
)
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite share of each layer's cells, and its steps with data."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.when(k % 9 == 0, float("nan")).when(k % 8 > 0, F.col("value")).alias("value"), F.to_date("ts").alias("day"))
    steps = rows.select("layer", "day").distinct().select("layer", (F.dayofmonth("day") % 3 > 0).alias("valid"))
    return scenes.layer_report(rows, steps)


MATCHES = """
m as (select l_orderkey % 40 as pair, l_partkey % 60 as unit, l_quantity / 10 as displacement, l_discount as quality, l_suppkey % 5 = 0 and l_orderkey % 40 > 2 as stable from lineitem),
f as (select pair, coalesce(median(displacement) filter (where stable), 'nan'::double) as median_m, coalesce(quantile_cont(displacement, 0.95) filter (where stable), 'nan'::double) as p95_m, count(*) filter (where stable) as n_stable from m group by pair)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.col("l_orderkey") % 40
    return table(spark, sf_dir, "lineitem").select(pair.alias("pair"), (F.col("l_partkey") % 60).alias("unit"), (F.col("l_quantity") / 10).alias("displacement"), F.col("l_discount").alias("quality"), ((F.col("l_suppkey") % 5 == 0) & (pair > 2)).alias("stable"))


@query(f"with {MATCHES} select pair, round(median_m, 9) as median_m, round(p95_m, 9) as p95_m, n_stable from f")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement over stable ground of each pair; NaN where there is none."""
    return scenes.noise_floor(_matches(spark, sf_dir), "pair").withColumns({c: rounded(c, 9) for c in ("median_m", "p95_m")})


@query(
    f"""
with {MATCHES}, u as (select pair, unit from (select distinct pair from m), (select unnest(range(62)) as unit)), g as (select pair, unit, median(displacement) as d, count(*) as n from m where quality >= 0.05 group by all),
j as (select pair, unit, d, coalesce(n, 0) as n, median_m from u left join g using (pair, unit) join f using (pair))
select pair, unit, case when n >= 3 then round(d, 3) end as displacement_m, n as n_chips, n >= 3 and not isnan(median_m) and d > median_m as significant,
  case when n < 3 then 'too few good chips inside the unit' when not (not isnan(median_m) and d > median_m) then 'below the pair''s measured stable-ground noise floor' end as reason from j"""
)
def unit_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median displacement of every unit against its pair's noise floor."""
    matches = _matches(spark, sf_dir)
    units = matches.select("pair").distinct().withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(61).cast("long"))))
    return scenes.unit_displacement(matches, units, scenes.noise_floor(matches, "pair"), "pair", 0.05)


@query(
    """
with p as (select l_orderkey % 50 as track, l_partkey % 30 as r, l_suppkey % 30 as c, l_discount * 10 as coherence, l_quantity as slope, l_linenumber = 3 as hidden from lineitem),
o as (select *, count(*) over (partition by track) as n_candidates, row_number() over (partition by track order by coherence desc, r, c) as k from p where coherence >= 0.85 and slope < 25 and not hidden)
select track, r, c, coherence, n_candidates from o where k = 1"""
)
def reference_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("track"), (F.col("l_partkey") % 30).alias("r"), (F.col("l_suppkey") % 30).alias("c"), (F.col("l_discount") * 10).alias("coherence"), F.col("l_quantity").alias("slope"), (F.col("l_linenumber") == 3).alias("hidden"))
    return scenes.reference_point(rows, "track", 0.85, 25.0)


@query(
    """
with f as (select s_suppkey as id, s_suppkey % 60 - 30 as la, s_suppkey % 170 as lo, 0.2::double + s_suppkey % 7 / 50.0::double as a, 0.8::double + s_suppkey % 5 / 10.0::double as b, case when s_suppkey % 2 = 0 then 'ASCENDING' else 'descending' end as d from supplier),
p as (select *, [lo, lo + b, lo + b + a / 9, lo + a / 9] as x, [la, la + 0.1, la + 0.1 + a, la + a] as y from f),
e as (select id, d, i, (x[i % 4 + 1] - x[i]) * cos(radians((y[1] + y[2] + y[3] + y[4]) / 4)) as e, y[i % 4 + 1] - y[i] as n from p, (select unnest(range(1, 5)) as i)),
h as (select id, d, (degrees(atan2(arg_min(e, (sqrt(e * e + n * n), i)), arg_min(n, (sqrt(e * e + n * n), i)))) + 360) % 360 as a from e group by id, d)
select id, round(case when (d = 'ASCENDING') = (a < 90 or a > 270) then a else (a + 180) % 360 end, 6) as heading from h"""
)
def footprint_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading from the shortest edge of a footprint and the direction of flight."""
    k = F.col("s_suppkey")
    la, lo, a, b = (k % 60 - 30).cast("double"), (k % 170).cast("double"), 0.2 + k % 7 / 50.0, 0.8 + k % 5 / 10.0
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(at(lo, la), at(lo + b, la + 0.1), at(lo + b + a / 9, la + 0.1 + a), at(lo + a / 9, la + a), at(lo, la))
    direction = F.when(k % 2 == 0, "ASCENDING").otherwise("descending")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), rounded(scenes.heading(ring, direction)).alias("heading"))


@query(
    """
with g as (select event_id, user_id, ts, value from events)
select event_id, user_id || '_IW' || (event_id % 3 + 1) as burst, round(30 * (user_id + 0.5::double), 6) as x, round(9000 - 30 * (event_id % 50 + 0.5::double), 6) as y, round(0.5::double + round_even((least(greatest(value / 20, 0.5), 15) - 0.5) / 0.05, 0) * 0.05, 6) as distance,
  round(value / (case when event_id % 2 = 0 then 12.0::double else (event_id % 40 + 1) / 2.0::double end / 365.25::double), 8) as velocity from g"""
)
def names_and_lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts from names, pixel centres, distances on a lattice, and displacement a year."""
    k, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    granule = F.concat_ws("_", F.lit("S1"), u.cast("string"), F.concat(F.lit("IW"), (k % 3 + 1).cast("string")), F.lit("20200608T124746_VV_7D8B-BURST"))
    days = scenes.baseline_days(F.when(k % 2 == 0, 12.0), micros("ts"), micros("ts") + (k % 40 + 1) * 43_200_000_000)
    return table(spark, sf_dir, "events").select(
        "event_id", scenes.burst_id(granule).alias("burst"), rounded(scenes.pixel_centre(F.lit(0.0), u, F.lit(30.0))).alias("x"), rounded(scenes.pixel_centre(F.lit(9000.0), k % 50, F.lit(30.0), True)).alias("y"),
        rounded(scenes.lattice(v / 20)).alias("distance"), rounded(scenes.velocity(v, days), 8).alias("velocity"),
    )


@query("select event_id, sha256('{\"a\":\"' || user_id || '\",\"b\":\"' || event_type || '\"}') as hash from events")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload's hash doesn't depend on the order of its keys."""
    both = F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", scenes.stable_hash(both).alias("hash"))
