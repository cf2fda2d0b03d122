"""Checks of records and ledgers, geometry and tracks, titles, and the assembled catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.checkpoints import cut
from moraine.functions import text
from moraine.operators import catalog, contracts, ensemble, ledger
from moraine.plans import catalog as matching
from moraine.plans.base import DAY_US, ORACLE_SQL, micros, query, rounded
from moraine.streaming import detector
from moraine.tables import table


@query(
    """
with x as (select l_orderkey as id, l_linenumber as line, l_extendedprice as low, l_extendedprice * (0.95 + l_discount * 2) as high, case when l_partkey % 3 = 0 then l_extendedprice * 1.02 end as best, case when l_suppkey % 4 = 0 then [l_returnflag, l_returnflag] when l_suppkey % 17 = 0 then [] else [l_returnflag, l_linestatus || 'x'] end as refs,
    l_partkey % 5 = 0 as disputed, case when l_quantity > 25 then ['m3', case when l_linenumber = 2 then 'kg' else 'm3' end] when l_quantity > 10 then ['m3'] else [] end as units, case when l_suppkey % 6 > 0 then 'n' else '' end as notes from lineitem),
r as (select unnest([case when low > high then 'low exceeds high' end, case when best is not null and not best between low and high then 'best outside' end, case when len(list_distinct(refs)) < len(refs) then 'duplicate references' end, case when len(refs) < 1 then 'no reference' end,
    case when len(list_filter(units, lambda u: u <> 'm3')) > 0 then 'unit of an estimate differs' end, case when disputed and best is not null then 'disputed with best' end, case when disputed and len(units) < 2 then 'disputed with fewer than two estimates' end, case when disputed and notes = '' then 'disputed without notes' end]) as problem from x)
select problem, count(*) as n from r where problem is not null group by problem"""
)
def interval_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many intervals break each rule; one can break several."""
    x, part, supp, q = F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    flag = F.col("l_returnflag")
    refs = F.when(supp % 4 == 0, F.array(flag, flag)).when(supp % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(flag, F.concat("l_linestatus", F.lit("x"))))
    unit = lambda u: F.struct(u.alias("unit"))
    m3 = F.lit("m3")
    estimates = F.when(q > 25, F.array(unit(m3), unit(F.when(F.col("l_linenumber") == 2, "kg").otherwise(m3)))).when(q > 10, F.array(unit(m3))).otherwise(F.array().cast("array<struct<unit:string>>"))
    problems = contracts.range_problems(x, x * (0.95 + F.col("l_discount") * 2), F.when(part % 3 == 0, x * 1.02), m3, refs, part % 5 == 0, estimates, F.when(supp % 6 > 0, "n").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    """
with r as (select l_orderkey as entry, l_linenumber as k, case when l_partkey % 9 > 0 then 'f' || l_partkey % 500 end as path, (epoch_us(l_shipdate) // 86400000000)::bigint as day, l_orderkey * 100000 + l_partkey * 8 + l_linenumber as place, l_returnflag as status from lineitem)
select path, day, place, status from (select *, row_number() over (partition by path order by day desc, place desc) as n from r where path is not null) where n = 1"""
)
def latest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each file; rows that name none are left out."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.when(k % 9 > 0, F.concat(F.lit("f"), (k % 500).cast("string"))).alias("path"), F.floor(micros("l_shipdate") / DAY_US).alias("day"), (F.col("l_orderkey") * 100_000 + k * 8 + F.col("l_linenumber")).alias("place"), F.col("l_returnflag").alias("status"))
    return ledger.latest_by_path(rows, "path", F.col("day"), "place").select("path", "day", "place", "status")


@query(
    """
with e as (select ['s1', 's2', 'dem'][l_orderkey % 3 + 1] as source, case when l_partkey % 7 = 0 then null when l_partkey % 2 = 0 then 'iw_slc_' || l_linenumber else 'GRD-H' end as level from lineitem)
select count(*) filter (where source = 's1' and (level is null or contains(upper(level), 'SLC'))) as slc, count(*) filter (where source = 's1' and (level is null or contains(upper(level), 'GRD'))) as grd, count(*) filter (where source in ('s2')) as optical, count(*) filter (where source = 'dem') as terrain from e"""
)
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each column; two share a source and are told apart by the product level, an unknown one counts in both."""
    k = F.col("l_partkey")
    source = F.element_at(F.array(*map(F.lit, ("s1", "s2", "dem"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    level = F.when(k % 7 == 0, F.lit(None)).when(k % 2 == 0, F.concat(F.lit("iw_slc_"), F.col("l_linenumber").cast("string"))).otherwise("GRD-H")
    sources = {"slc": ("s1",), "grd": ("s1",), "optical": ("s2",), "terrain": ("dem",)}
    rows = table(spark, sf_dir, "lineitem").select(source.alias("source"), level.alias("level"))
    return rows.agg(*[F.count_if(ledger.in_column(c, F.col("source"), F.col("level"), sources, {"slc": "SLC", "grd": "GRD"})).alias(c) for c in sources])


@query(
    """
with e as (select l_suppkey % 300 as scene, ['B02', 'B03', 'B08', 'B12'][l_partkey % 4 + 1] as part, (epoch_us(l_shipdate) // 86400000000)::bigint as ts, (epoch_us(l_shipdate) // 86400000000)::bigint + l_orderkey % 17 as recorded, l_orderkey * 100000 + l_partkey * 8 + l_linenumber as entry from lineitem),
n as (select scene, part, arg_max(entry, (recorded, entry)) as entry from e where part in ('B02', 'B03', 'B08') and ts between 8500 and 9200 group by scene, part)
select scene, part, entry from n where scene in (select scene from n group by scene having count(*) = 3)"""
)
def whole_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each band of the scenes that have all three within the window."""
    band = F.element_at(F.array(*map(F.lit, ("B02", "B03", "B08", "B12"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    place = F.col("l_orderkey") * 100_000 + F.col("l_partkey") * 8 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 300).alias("scene"), band.alias("part"), F.floor(micros("l_shipdate") / DAY_US).alias("ts"), (F.floor(micros("l_shipdate") / DAY_US) + F.col("l_orderkey") % 17).alias("recorded"), place.alias("place"), place.alias("entry"))
    return ledger.whole_scenes(rows, ("B02", "B03", "B08"), F.lit(8500), F.lit(9200)).select("scene", "part", "entry")


@query(
    """
with e as (select l_suppkey % 40 as aoi, case when l_partkey % 11 = 0 then null when l_suppkey % 40 < 30 then 'beta' when l_partkey % 2 = 0 then 'Provisional' else 'BETA' end as level from lineitem where l_returnflag = 'A')
select aoi, count(distinct lower(coalesce(level, ''))) as n_levels, count(distinct lower(coalesce(level, ''))) > 1 as mixed, count(*) filter (where lower(coalesce(level, '')) not in ('beta', 'provisional')) as n_unknown from e group by aoi"""
)
def level_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product levels of what was fetched for each area: more than one, or one that isn't known, is refused."""
    k, area = F.col("l_partkey"), F.col("l_suppkey") % 40
    level = F.when(k % 11 == 0, F.lit(None)).when(area < 30, "beta").when(k % 2 == 0, "Provisional").otherwise("BETA")
    known = F.lower(F.coalesce(level, F.lit("")))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(area.alias("aoi"), known.alias("level"))
    n = F.count_distinct("level")
    return rows.groupBy("aoi").agg(n.alias("n_levels"), (n > 1).alias("mixed"), F.count_if(~F.col("level").isin("beta", "provisional")).alias("n_unknown"))


@query(
    f"""
with {matching.STATIONS},
ch as (select event_id, station_id, c, km / 111.0::double as distance, azimuth, (station_id * 7 + c * 3) % 23 + 0.5::double as snr from near, (values (0), (1), (2)) x(c) where (station_id + c) % 4 > 0),
s as (select event_id, station_id, min(azimuth) as azimuth from ch group by all),
g as (select event_id, azimuth, coalesce(lead(azimuth) over w, min(azimuth) over (partition by event_id) + 360) - azimuth as step from s window w as (partition by event_id order by azimuth)),
a as (select event_id, count(*) as n_stations, round(case when count(*) < 2 then 360 else max(step) end, 5)::double as gap from g group by event_id)
select event_id, n_channels, min_distance, max_distance, median_snr, n_stations, gap from a join (select event_id, count(*) as n_channels, round(min(distance), 6) as min_distance, round(max(distance), 6) as max_distance, median(snr) as median_snr from ch group by event_id) using (event_id)"""
)
def event_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels, stations, distances, median signal-to-noise ratio and gap of each event."""
    pairs = matching.station_pairs(spark, sf_dir).withColumn("channel", F.explode(F.array(*map(F.lit, (0, 1, 2))))).where((F.col("station_id") + F.col("channel")) % 4 > 0)
    channels = pairs.select("event_id", F.col("station_id").alias("station"), "channel", (F.col("km") / 111.0).alias("distance_deg"), "azimuth", ((F.col("station_id") * 7 + F.col("channel") * 3) % 23 + 0.5).cast("double").alias("snr"))
    out = catalog.geometry(channels, "event_id")
    return out.select("event_id", "n_channels", rounded("min_distance").alias("min_distance"), rounded("max_distance").alias("max_distance"), "median_snr", "n_stations", rounded("gap", 5).alias("gap"))


@query(
    """
with b as (select user_id as track, ts, value / 500 as sensitivity, (event_id % 10) / 40.0::double as hidden from events),
p as (select track, epoch_us(min(ts)) / 86400e6::double as d from b group by track, date_trunc('hour', ts)),
g as (select track, d, d - lag(d) over (partition by track order by d) as gap from p),
m as (select track, count(*) as n_scenes, max(gap) as inner_gap, median(gap) as median_gap, min(d) - 19723 as before, 19752 - max(d) as after from g group by track),
s as (select track, count(*) as n_bursts, avg(sensitivity) as sensitivity, avg(hidden) as hidden from b group by track),
r as (select *, greatest(inner_gap, case when before > 0 then before end, case when after > 0 then after end) as max_gap, least(1, n_scenes / greatest(29 / 12.0::double, 1)) as coverage from m join s using (track)),
e as (select *, concat_ws(', ', case when n_scenes < 8 then 'too few scenes' end, case when max_gap > 6 then 'gap too wide' end, case when hidden > 0.12 then 'layover or shadow' end) as reasons from r)
select track, n_scenes, n_bursts, round(max_gap, 6) as max_gap, round(median_gap, 6) as median_gap, round(sensitivity, 6) as sensitivity, round(hidden, 6) as hidden, round(coverage, 6) as coverage, reasons, reasons = '' as eligible, round(case when reasons = '' then sensitivity * (1 - hidden) * coverage else 0 end, 6) as score from e"""
)
def track_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes, gaps, coverage, reasons against and score of each track in January 2024."""
    bursts = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("place"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("value") / 500).alias("sensitivity"), ((F.col("event_id") % 10) / 40.0).alias("hidden"))
    out = catalog.track_metrics(bursts, "track", F.lit(19_723.0), F.lit(19_752.0), 8, 6.0, 0.12)
    return out.select("track", "n_scenes", "n_bursts", *[rounded(c).alias(c) for c in ("max_gap", "median_gap", "sensitivity", "hidden", "coverage")], F.array_join("reasons", ", ").alias("reasons"), "eligible", rounded("score").alias("score"))


@query(
    """
with c as (select o_custkey % 50 as site, o_orderkey as id, epoch_us(o_orderdate) // 86400000000 as day, coalesce(case when o_orderkey % 9 > 5 then (o_totalprice % 100) / 100 end, case when o_orderkey % 9 > 1 then (o_orderkey % 101)::double / 100.0::double end) as cloud from orders)
select site, id, round(cloud, 6) as cloud, rank::int as rank from (select *, row_number() over (partition by site order by cloud, day desc, id) as rank from c where cloud <= 0.6) where rank <= 3"""
)
def clearest_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three clearest scenes of each site, by the cloud over the area, or the tile's percentage where that isn't known; a scene without either takes no part."""
    from moraine.operators import ranges

    k = F.col("o_orderkey")
    cloud = F.coalesce(F.when(k % 9 > 5, (F.col("o_totalprice") % 100) / 100), F.when(k % 9 > 1, (k % 101).cast("double") / 100.0))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("site"), k.alias("id"), F.floor(micros("o_orderdate") / DAY_US).alias("day"), cloud.alias("cloud")).where("cloud <= 0.6")
    return ranges.first_k(rows, ["site"], [F.col("cloud"), F.col("day").desc(), F.col("id")], 3).select("site", "id", rounded("cloud").alias("cloud"), F.col("rank").cast("int").alias("rank"))


@query(
    """
with a as (select user_id, epoch_us(ts) // 3600000000 as t, sum(value) as v from events where event_type = 'click' group by all), b as (select user_id, epoch_us(ts) // 3600000000 as t, avg(value) as c from events where event_type = 'view' group by all)
select user_id, t, round(v, 6) as v, round(c, 6) as c from a join b using (user_id, t)"""
)
def shared_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series of a unit at the times that both have."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(micros("ts") / 3_600_000_000).alias("t"), "value")
    a = rows.where("event_type = 'click'").groupBy("user_id", "t").agg(F.sum("value").alias("v"))
    b = rows.where("event_type = 'view'").groupBy("user_id", "t").agg(F.avg("value").alias("c"))
    return a.join(b, ["user_id", "t"]).select("user_id", "t", rounded("v").alias("v"), rounded("c").alias("c"))


@query(
    f"""
with {matching.EVENTS}, m as ({ORACLE_SQL["match_negatives_topk"]}), w as ({ORACLE_SQL["noise_windows_anti"]}),
p as (select event_id, t from ev where event_type = 'error'), n as (select positive_id, count(*) as n from m group by 1)
select 'positive' as kind, event_id as positive_id, event_id as id, t as origin, coalesce(n, 0) < 5 as short from p left join n on positive_id = event_id
union all select 'tectonic', positive_id, negative_id, t, false from m join ev on event_id = negative_id
union all select 'noise', event_id, k, mid, false from w"""
)
def assembled_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives, the negatives matched to them and their noise windows as one catalogue; a positive says whether it is short of negatives."""
    ev = matching.events(spark, sf_dir)
    negatives = cut(matching.match_negatives_topk(spark, sf_dir))
    few = negatives.groupBy(F.col("positive_id").alias("event_id")).agg(F.count("*").alias("n"))
    return catalog.assemble(
        ev.where("event_type = 'error'").join(few, "event_id", "left").select(F.col("event_id").alias("id"), F.col("t").alias("origin"), (F.coalesce("n", F.lit(0)) < 5).alias("short")),
        negatives.join(ev.select(F.col("event_id").alias("negative_id"), "t"), "negative_id").select("positive_id", F.col("negative_id").alias("id"), F.col("t").alias("origin")),
        matching.noise_windows_anti(spark, sf_dir).select(F.col("event_id").alias("positive_id"), F.col("k").alias("id"), F.col("mid").alias("origin")),
    )


@query()
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages, and of the same in JSON for every fifth; all entities are resolved, which isn't SQL."""
    k = F.col("page_id")
    body = F.when(k % 5 == 0, F.to_json(F.struct(F.struct(F.array(F.concat(F.lit("A &eacute;&#233;&#xe9; &amp; "), k.cast("string"))).alias("title")).alias("message")))).otherwise(F.col("html"))
    kind = F.when(k % 5 == 0, "application/json; charset=utf-8").when(k % 7 == 0, "text/plain").otherwise("Text/HTML")
    return table(spark, sf_dir, "pages").select("page_id", text.document_title(body, kind).alias("title"))


@query(
    """
with x as (select l_orderkey * 10 + l_linenumber as asset, case when l_suppkey % 11 > 0 then s_nationkey end as transect, case when l_tax > 0 then l_extendedprice end as lo, case when l_tax > 0 then l_extendedprice * 1.2 end as hi, 2.0::double + l_linenumber / 4.0::double as d0 from lineitem join supplier on l_suppkey = s_suppkey),
a as (select n_nationkey as transect, 20.0::double + n_nationkey * 3 as alo, 30.0::double + n_nationkey * 4 as ahi, case when n_nationkey % 6 > 0 then n_nationkey / 8.0::double end as dlo, case when n_nationkey % 6 > 0 then n_nationkey / 5.0::double end as dhi from nation where n_nationkey % 5 > 0),
s as (select r_regionkey as scenario, case when r_regionkey > 0 then r_regionkey * 8.0::double end as delay from region),
f as (select *, case when x.transect is null then 'no_transect' when alo is null then 'no_arrival' when dlo is null then 'no_flow_depth' when lo is null then 'no_replacement_value' end as reason, lo * case when dlo <= 0 then 0 else least(1, 1 - exp(-((dlo / (d0 * 1.2)) ** 2))) end as blo, hi * case when dhi <= 0 then 0 else least(1, 1 - exp(-((dhi / (d0 * 0.8)) ** 2))) end as bhi,
    case when delay is null then 0 else least(1, greatest(0, (alo - delay - 10) / 50)) * 0.3 end as slo, case when delay is null then 0 else least(1, greatest(0, (ahi - delay - 10) / 50)) * 0.6 end as shi from x left join a on x.transect = a.transect cross join s),
g as (select *, blo * (1 - shi) as llo, bhi * (1 - slo) as lhi from f)
select scenario, coalesce(reason, 'computed') as reason, count(*) as n, round(sum(llo) filter (where reason is null), 1) as loss_low, round(sum(lhi) filter (where reason is null), 1) as loss_high,
  round(sum(greatest(0, least(blo - lhi, bhi - llo))) filter (where reason is null and delay is not null), 1) as avoided_low, round(sum(greatest(0, blo - lhi, bhi - llo)) filter (where reason is null and delay is not null), 1) as avoided_high from g group by 1, 2"""
)
def warned_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every asset with and without a warning, by scenario and by what blocks them; the baseline avoids nothing."""
    items, k = table(spark, sf_dir, "lineitem"), F.col("n_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    priced = lambda f: F.when(F.col("l_tax") > 0, F.col("l_extendedprice") * f)
    exposure = items.join(supplier, items["l_suppkey"] == supplier["s_suppkey"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset"), F.when(F.col("l_suppkey") % 11 > 0, F.col("s_nationkey")).alias("transect"), priced(1.0).alias("value_low"), priced(1.2).alias("value_high"), (2.0 + F.col("l_linenumber") / 4.0).alias("scale"))
    deep = lambda f: F.when(k % 6 > 0, k / f)
    arrivals = table(spark, sf_dir, "nation").where(k % 5 > 0).select(k.alias("transect"), (20.0 + k * 3).alias("arrival_low"), (30.0 + k * 4).alias("arrival_high"), deep(8.0).alias("depth_low"), deep(5.0).alias("depth_high"))
    r = F.col("r_regionkey")
    scenarios = table(spark, sf_dir, "region").select(r.alias("scenario"), F.when(r > 0, r * 8.0).alias("delay_min"))
    rows = ensemble.warned_losses(exposure, arrivals, scenarios, 2.0, (1.2, 0.8), (10.0, 60.0), (0.3, 0.6))
    sums = [rounded(F.sum(c), 1).alias(c) for c in ("loss_low", "loss_high", "avoided_low", "avoided_high")]
    return rows.groupBy("scenario", F.coalesce("reason", F.lit("computed")).alias("reason")).agg(F.count("*").alias("n"), *sums)


@query(
    """
with m as (select event_type as kind, epoch_us(ts) as t from events where event_type <> 'view' union all select 'alert', epoch_us(ts) + 5000000 from events where value > 400)
select kind, count(*) as n, min(t) as first_us, round((min(t) - 1704067200000000) / 1e6::double, 6) as latency_s, round((min(t) - (select min(t) from m)) / 1e6::double / 60, 6) as due_wall_s from m group by kind"""
)
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a replay by kind, the first of each, and its latency in stream time and in wall time at sixty times the speed."""
    ev = table(spark, sf_dir, "events").select("event_type", "value", micros("ts").alias("t"))
    messages = ev.where("event_type <> 'view'").select(F.col("event_type").alias("kind"), F.col("t").alias("stream_us")).unionByName(ev.where("value > 400").select(F.lit("alert").alias("kind"), (F.col("t") + 5_000_000).alias("stream_us")))
    out = detector.replay_report(messages, F.lit(1_704_067_200_000_000), 60.0)
    return out.select("kind", "n", "first_us", rounded("latency_s").alias("latency_s"), rounded("due_wall_s").alias("due_wall_s"))


@query(
    """
with w as (select doc_id as entry, source as grp, case when doc_id % 3 > 0 then doc_id - doc_id % 3 end as matched, list_transform(range(1 + n_chars % 5), lambda k: (doc_id % 2 + k * (1 + doc_id % 3)) % 6) as stations from documents),
x as (select a.entry, b.entry is null as orphan, b.entry is not null and b.grp <> a.grp as other_group, b.entry is not null and len(list_filter(a.stations, lambda s: not list_contains(b.stations, s))) > 0 as more_stations from w a left join w b on a.matched = b.entry where a.matched is not null)
select count(*) as n_matched, count(*) filter (where orphan) as n_orphans, count(*) filter (where other_group) as n_other_group, count(*) filter (where more_stations) as n_more_stations, case when count(*) filter (where orphan) > 0 then 3 when count(*) filter (where other_group or more_stations) > 0 then 1 else 0 end as exit_code from x"""
)
def catalogue_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched entries whose positive isn't there, is of another group, or has not all of their stations, and the code that a check ends with."""
    d = F.col("doc_id")
    stations = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_chars") % 5), lambda k: (d % 2 + k * (1 + d % 3)) % 6)
    rows = table(spark, sf_dir, "documents").select(d.alias("entry"), F.col("source").alias("group"), F.when(d % 3 > 0, d - d % 3).alias("matched"), stations.alias("stations"))
    return catalog.integrity(rows)
