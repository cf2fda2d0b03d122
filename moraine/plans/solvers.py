"""Emulated corridors, releases, profiles, rotations, channel preparation, chip tracking, location and training, and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import quantiles as Q
from moraine.functions import geo, text
from moraine.operators import grids, surrogate, waveforms
from moraine.plans.base import query, rounded
from moraine.tables import table

BINS = "b as (select l_orderkey % 60 as member, l_partkey % 7 as transect, l_quantity / 20 as truth, l_quantity / 20 + (l_partkey % 5 - 2) * 0.5::double as median, l_discount * 12 as reach, l_quantity / 20 - l_tax * 9 as low, l_quantity / 20 + (l_suppkey % 4 - 1) * 0.3::double as high from lineitem)"


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity") / 20
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 60).alias("member"), (F.col("l_partkey") % 7).alias("transect"), q.alias("truth"), (q + (F.col("l_partkey") % 5 - 2) * 0.5).alias("median"), (F.col("l_discount") * 12).alias("reach"), (q - F.col("l_tax") * 9).alias("low"), (q + (F.col("l_suppkey") % 4 - 1) * 0.3).alias("high"))


@query(
    f"""
with {BINS}, m as (select member, count(*) filter (where truth > 1 and median > 1 and reach > 0.5) / nullif(count(*) filter (where truth > 1 or (median > 1 and reach > 0.5)), 0)::double as iou from b group by member)
select count(iou) as members, round(quantile_cont(iou, 0.25), 9) as p25, round(quantile_cont(iou, 0.5), 9) as median, round(quantile_cont(iou, 0.75), 9) as p75, (select round(avg((truth between low and high)::int) filter (where truth > 1), 9) from b) as wet, (select round(avg((truth between low and high)::int), 9) from b) as "all" from m"""
)
def surrogate_inundation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of wet bins by member, and coverage of intervals over wet bins and over all."""
    bins = _bins(spark, sf_dir)
    iou = surrogate.overlap_by_member(bins, "member").agg(F.count("iou").alias("members"), *[rounded(Q.linear("iou", q), 9).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])
    return iou.crossJoin(surrogate.interval_coverage(bins).select(rounded("wet", 9).alias("wet"), rounded("all", 9).alias("all")))  # one row each


@query(f"with {BINS}, a as (select transect, case when truth > 0.5 then truth end as truth, median, reach as stage, reach + transect / 10.0::double as sm from b) select transect, count(truth) as n, round(avg(abs(median - truth)), 9) as mae, round(avg(case when truth is not null then abs(sm - stage) end) / nullif(avg(case when truth is not null then abs(stage) end), 0), 9) as stage_error from a group by transect")
def surrogate_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bins(spark, sf_dir).select("transect", F.when(F.col("truth") > 0.5, F.col("truth")).alias("truth"), "median", F.col("reach").alias("stage"), (F.col("reach") + F.col("transect") / 10.0).alias("stage_median"))
    return surrogate.arrival_errors(rows, "transect").withColumns({c: rounded(c, 9) for c in ("mae", "stage_error")})


@query(
    """
with c as (select p_retailprice + p_partkey % 300 as z from part where (p_partkey % 100) * 80 <= 6000),
m as (select s_suppkey as member, (1 + s_suppkey % 20) * 400000.0::double as volume, case when s_suppkey % 9 = 0 then 90000 else 900 + s_suppkey * 10 end::double as low, case when s_suppkey % 9 = 0 then 90010 else 905 + s_suppkey * 10 end::double as high from supplier),
n as (select member, volume, low, high, volume / 300 / 900.0::double as need from m),
w as (select n.*, k, (select count(*) from c where z >= low - k * 100 and z <= high + k * 100) as cells from n, (select unnest(range(31)) as k)),
p as (select member, volume, need, low, high, coalesce(min(k) filter (where cells >= need), 30) as k from w group by all),
b as (select p.member, p.volume, w.cells, p.low - p.k * 100 as low, p.high + p.k * 100 as high from p join w using (member, k) where w.cells > 0),
o as (select z, row_number() over (order by z desc) as r from c),
h as (select member, volume, count(*) as cells, min(z) as low, max(z) as high from p, o where member not in (select member from b) and r <= greatest(1, floor(need)) group by member, volume),
e as (select * from b union all select * from h)
select member, cells, round(least(volume / (cells * 900), 300), 6) as depth, round(low, 6) as low, round(high, 6) as high, round(1 - least(volume / (cells * 900), 300) * cells * 900 / volume, 6) as shortfall from e"""
)
def release_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes spread over elevation bands that widen until they hold them."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    cells = table(spark, sf_dir, "part").select((F.col("p_retailprice") + k % 300).alias("z"), ((k % 100) * 80).cast("double").alias("chainage"))
    low = F.when(s % 9 == 0, 90000.0).otherwise(900.0 + s * 10)
    members = table(spark, sf_dir, "supplier").select(s.alias("member"), ((1 + s % 20) * F.lit(400_000.0)).alias("volume"), low.alias("low"), F.when(s % 9 == 0, low + 10).otherwise(low + 5).alias("high"))
    out = surrogate.releases(cells, members, 900.0)
    return out.select("member", "cells", *[rounded(c).alias(c) for c in ("depth", "low", "high", "shortfall")])


@query(
    """
with e as (select vec_id, radians(vec_id % 360) as a, [x::double for x in embedding] as x from embeddings where embedding is not null),
s as (select vec_id, cos(a) as c, sin(a) as s, list_sum(x) as z, list_sum([v * v for v in x]) as r, list_sum([v * 2 for v in x]) as t from e)
select vec_id, round(c * z, 6) as "ZN", round(s * r, 6) as "EU", round(c * c * z + s * s * t, 6) as "NN", round(c * s * (z - t), 6) as "NE", round(s * s * z + c * c * t, 6) as "EE" from s"""
)
def rotated_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the records at Z, N and E of unit forces."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    square, twice = F.transform(x, lambda v: v * v), F.transform(x, lambda v: v * 2)
    found = waveforms.rotated((F.col("vec_id") % 360).cast("double"), (x, square), (x, x), twice)
    total = lambda a: rounded(F.aggregate(a, F.lit(0.0), lambda s, v: s + v))
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", *[total(found[k]).alias(k) for k in ("ZN", "EU", "NN", "NE", "EE")])


@query(
    """
with u as (select p_partkey % 12 as zone, p_size > 25 as ever, case when p_partkey % 3 > 0 then ['low_coherence', 'outside_footprint'][p_partkey % 2 + 1] end as reason, ['quiet', 'watch'][p_partkey % 2 + 1] as tier from part)
select zone, ever as measurable, case when ever then tier else coalesce(reason, 'unknown') end as why, count(*) as n from u group by all"""
)
def neighbourhood_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select((k % 12).alias("zone"), (F.col("p_size") > 25).alias("ever"), F.when(k % 3 > 0, F.when(k % 2 == 0, "low_coherence").otherwise("outside_footprint")).alias("reason"), F.when(k % 2 == 0, "quiet").otherwise("watch").alias("tier"))
    return surrogate.neighbourhood(rows, "zone")


@query("select s_suppkey as unit, 760::int as step, 'insufficient_data' as tier, null::double as score, 'model_not_trained' as reason from supplier")
def refusing_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch without weights refuses every unit."""
    return surrogate.refusing_watch(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit")), "unit", F.lit(760))


@query("select o_custkey % 30 as orbit, string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey) as products from orders where o_orderstatus = 'P' group by 1")
def products_by_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 30).alias("orbit"), "o_orderdate", "o_orderkey")
    return surrogate.by_orbit(rows, "orbit", "o_orderdate", "o_orderkey").select("orbit", F.array_join(F.transform("products", lambda k: k.cast("string")), ",").alias("products"))


@query(
    """
with l as (select case when o_custkey % 5 > 0 then o_custkey end as request, ['requested', 'fetched', 'failed'][o_orderkey % 3 + 1] as status, (epoch_us(o_orderdate) // 86400000000)::bigint as recorded_at, o_orderkey as place from orders),
r as (select request, arg_max(status, (recorded_at, -place)) as status, max(recorded_at) as recorded_at from l where request is not null group by request)
select c_custkey as request, coalesce(status, 'unknown') as state, recorded_at from customer left join r on c_custkey = request"""
)
def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))") / 86_400_000_000)
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("request"), F.when(k % 3 == 0, "requested").when(k % 3 == 1, "fetched").otherwise("failed").alias("status"), day.alias("recorded_at"), k.alias("place"))
    return surrogate.request_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request")), rows)


@query(
    """
select p_partkey as id, case when p_partkey % 7 = 0 then 'HTTP 404' when p_partkey % 11 = 0 then 'non-JSON' when p_partkey % 13 = 0 then 'no work record' when p_partkey % 5 = 0 then 'another DOI' end as problem,
  case when p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_partkey % 13 = 0 or p_partkey % 5 = 0 then null else 'A & B ' || p_partkey end as title, case when p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_partkey % 13 = 0 or p_partkey % 5 = 0 then null else 1990 + p_size end as year,
  case when p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_partkey % 13 = 0 or p_partkey % 5 = 0 then null else 'Doe, J; Group' end as authors from part"""
)
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works parsed from responses, or what is wrong with a response."""
    k = F.col("p_partkey")
    doi = F.concat(F.lit("10.1/ABC"), k.cast("string"))
    body = F.concat(F.lit('{"status":"ok","message":{"DOI":"10.1/abc'), F.when(k % 5 == 0, F.lit("x")).otherwise(k.cast("string")), F.lit('","title":["A &amp; B  '), k.cast("string"), F.lit('"],"author":[{"family":"Doe","given":"J"},{"name":"Group"},{}],"issued":{"date-parts":[['), (1990 + F.col("p_size")).cast("string"), F.lit(',1]]}}}'))
    body = F.when(k % 11 == 0, "<html>").when(k % 13 == 0, '{"status":"ok"}').otherwise(body)
    rows = table(spark, sf_dir, "part").select(k.alias("id"), text.crossref(doi, F.when(k % 7 == 0, 404).otherwise(200), body).alias("w"))
    good = F.col("w.problem").isNull()
    return rows.select("id", "w.problem", F.when(good, F.col("w.title")).alias("title"), F.when(good, F.col("w.year")).alias("year"), F.when(good, F.array_join("w.authors", "; ")).alias("authors"))


@query()
def prepared_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows cut from traces, or why a trace is dropped. Filters aren't SQL."""
    k = F.col("vec_id")
    channel = F.when(k % 7 == 0, "HHX").when(k % 3 == 0, "HHZ").when(k % 3 == 1, "HHN").otherwise("HHE")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", channel.alias("channel"), F.lit(4.0).alias("rate"), (k % 6 - 1).cast("double").alias("offset_s"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    out = waveforms.prepare(rows, "vec_id", waveforms.Cut(2.0, 15.0, 0.8, 0.05, (0.05, 0.8)))
    return out.select("vec_id", "component", "dropped", F.size("samples").alias("n"))


@query()
def tracked_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements of chips between a scene and the same one moved by a cell each way."""
    k = F.col("event_id")
    at = lambda r, c: F.pmod(F.xxhash64(r, c), F.lit(997)).cast("double")
    grid = table(spark, sf_dir, "events").select(F.floor(k / 40).alias("r"), (k % 40).alias("c"))
    cells = grid.select(F.lit(1).alias("pair"), "r", "c", at(F.col("r"), F.col("c")).alias("a"), at(F.col("r") - 1, F.col("c") - 1).alias("b"))
    return waveforms.track_pair(cells, "pair", 8, 4, 3)


@query()
def located_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node whose kernels explain most of each group's traces."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("label", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("node"), e.alias("data"))
    kernel = F.transform("data", lambda x, i: F.get("data", F.pmod(i + F.col("node") - F.col("label") % 5, F.lit(64)).cast("int")))
    return surrogate.grid_search(rows.withColumn("kernel", kernel), "label", "node", 4, 1e-3)


@query(
    """
with p as (select p_partkey as id, ((p_partkey * 37) % 1800) / 10.0::double - 90 as la, ((p_partkey * 91) % 3600) / 10.0::double - 180 as lo from part),
g as (select *, degrees(atan((1 - 0.00669437999014::double) * tan(radians(la)))) as gl, degrees(atan((1 - 0.00669437999014::double) * tan(radians(30)))) as g0 from p)
select id, case when la between 25 and 38 and lo between 70 and 100 then 'himalaya' when la between 30 and 60 and (lo >= 170 or lo <= -120) then 'pacific' else 'other' end as region,
  round(degrees(2 * asin(sqrt(least(1, sin(radians(gl - g0) / 2) ** 2 + cos(radians(g0)) * cos(radians(gl)) * sin(radians(lo - 79) / 2) ** 2)))), 6) as distance,
  round((degrees(atan2(sin(radians(lo - 79)) * cos(radians(gl)), cos(radians(g0)) * sin(radians(gl)) - sin(radians(g0)) * cos(radians(gl)) * cos(radians(lo - 79)))) + 360) % 360, 4) as azimuth,
  floor((lo - 0.3) / 0.5) * 0.5 as west, ceil((lo + 0.7 + 0.3) / 0.5) * 0.5 as east from g"""
)
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, geocentric distance and azimuth from a source, and boxes snapped outward, of each point."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), ((k * 37) % 1800 / 10.0 - 90).alias("la"), ((k * 91) % 3600 / 10.0 - 180).alias("lo"))
    here, there = (F.lit(30.0), F.lit(79.0)), (F.col("la"), F.col("lo"))
    boxes = [("himalaya", 25.0, 38.0, 70.0, 100.0), ("pacific", 30.0, 60.0, 170.0, -120.0)]
    west, _, east, _ = geo.snapped_box(F.col("lo"), F.col("la"), F.col("lo") + 0.7, F.col("la"), 0.5, 0.3)
    azimuth = geo.azimuth_deg(geo.geocentric_lat(here[0]), here[1], geo.geocentric_lat(there[0]), there[1])
    return p.select("id", geo.region(*there, boxes).alias("region"), rounded(geo.geocentric_distance_deg(*here, *there)).alias("distance"), rounded(azimuth, 4).alias("azimuth"), west.alias("west"), east.alias("east"))


@query(
    """
with c as (select p_partkey // 40 as r, p_partkey % 40 as c, 5 + p_size::double as slope, (p_partkey * 7 % 360)::double as aspect, p_retailprice as z from part)
select (r // 3) * 100 + c // 8 as unit, count(*) as n, count(*) * 900.0::double as area, round(avg(slope), 6) as mean_slope, round((degrees(atan2(avg(sin(radians(aspect))), avg(cos(radians(aspect))))) + 360) % 360, 4) as mean_aspect, min(z) as min_z, max(z) as max_z, round(avg(z), 6) as mean_z from c group by 1"""
)
def zonal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, slope, circular mean aspect and elevations of units of cells."""
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.floor(k / 40).alias("r"), (k % 40).alias("c"), (5 + F.col("p_size").cast("double")).alias("slope"), (k * 7 % 360).cast("double").alias("aspect"), F.col("p_retailprice").alias("z"))
    units = cells.select("r", "c", (F.floor(F.col("r") / 3) * 100 + F.floor(F.col("c") / 8)).alias("unit"))
    return grids.zonal(cells, units, 900.0).withColumns({"mean_slope": rounded("mean_slope"), "mean_aspect": rounded("mean_aspect", 4), "mean_z": rounded("mean_z")})


@query(
    """
with n as (select event_id, 'NW.S' || user_id || '.' || case when event_id % 3 = 0 then '00' else '' end || '.HH' || ['Z', 'N', 'E'][event_id % 3 + 1] as key, event_type || ['_lat', '_Station_n', '_ratio', ''][event_id % 4 + 1] as name from events)
select event_id, split_part(key, '.', 1) as network, split_part(key, '.', 2) as station, split_part(key, '.', 3) as location, split_part(key, '.', 4) as channel, array_to_string(list_filter(['lat', 'lon', 'station', 'depth'], lambda t: contains(lower(name), t)), ',') as forbidden from n"""
)
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel keys in parts, and the tokens of feature names that would give a place or date away."""
    k = F.col("event_id")
    key = F.concat(F.lit("NW.S"), F.col("user_id").cast("string"), F.lit("."), F.when(k % 3 == 0, "00").otherwise(""), F.lit(".HH"), F.when(k % 3 == 0, "Z").when(k % 3 == 1, "N").otherwise("E"))
    name = F.concat("event_type", F.when(k % 4 == 0, "_lat").when(k % 4 == 1, "_Station_n").when(k % 4 == 2, "_ratio").otherwise(""))
    rows = table(spark, sf_dir, "events").select("event_id", text.sncl_parts(key).alias("p"), F.array_join(text.forbidden_tokens(name, ("lat", "lon", "station", "depth")), ",").alias("forbidden"))
    return rows.select("event_id", "p.*", "forbidden")
