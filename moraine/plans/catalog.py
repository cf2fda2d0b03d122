"""Catalogue matching, station choice, acquisition networks, scene and track selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.operators import catalog, ranges
from moraine.plans.base import DAY_US, micros, query, rounded
from moraine.tables import table

EVENTS = """
ev as (select event_id, event_type, user_id, value, epoch_us(ts) // 1000000 as t, 28 + (user_id % 40) / 10.0::double as lat, 80 + (event_id % 97) / 10.0::double as lon from events)"""
KM = "2 * 6371.0088 * asin(sqrt(least(1.0::double, sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)))"
AZ = "((degrees(atan2(sin(radians({b}.lon - {a}.lon)) * cos(radians({b}.lat)), cos(radians({a}.lat)) * sin(radians({b}.lat)) - sin(radians({a}.lat)) * cos(radians({b}.lat)) * cos(radians({b}.lon - {a}.lon)))) + 360) % 360)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = 28 + (F.col("user_id") % 40) / 10.0, 80 + (F.col("event_id") % 97) / 10.0
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", F.floor(micros("ts") / 1_000_000).alias("t"), lat.alias("lat"), lon.alias("lon"))


@query(
    f"""
with {EVENTS},
pairs as (
  select a.event_id as positive_id, b.event_id as negative_id, round({KM.format(a="a", b="b")}, 4) as km from ev a, ev b
  where a.event_type = 'error' and b.event_type = 'purchase' and b.value / 80 between 1 and 5 and abs(a.t - b.t) between 21600 and 172800)
select positive_id, negative_id, km, rank::int as rank from (select *, row_number() over (partition by positive_id order by km, negative_id) as rank from pairs where km <= 60) where rank <= 5"""
)
def match_negatives_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five candidates of each positive: near, but hours to days apart."""
    ev = events(spark, sf_dir)
    point = [F.col("event_id").alias("id"), "t", "lat", "lon"]
    a, b = ev.where("event_type = 'error'").select(*point), ev.where("event_type = 'purchase' and value / 80 between 1 and 5").select(*point)
    found = catalog.nearest_apart(a, b, 60.0, 21_600, 172_800, 5)
    return found.select(F.col("left_id").alias("positive_id"), F.col("right_id").alias("negative_id"), "km", "rank")


@query(
    f"""
with {EVENTS},
w as (select event_id, k, t + k * 21600 as mid from ev, (select unnest([-3, -2, -1, 1, 2, 3])::bigint as k) where event_type = 'error')
select event_id, k, mid from w where not exists (select 1 from ev e where e.value > 250 and e.t between mid - 1800 and mid + 1800)"""
)
def noise_windows_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at fixed offsets that hold no strong event."""
    ev = events(spark, sf_dir)
    offsets = F.explode(F.array(*[F.lit(k).cast("long") for k in (-3, -2, -1, 1, 2, 3)]))
    w = ev.where("event_type = 'error'").select("event_id", offsets.alias("k"), "t").withColumn("mid", F.col("t") + F.col("k") * 21_600)
    strong = ev.where("value > 250").select(F.col("t").alias("at"))
    return ranges.any_within(w, strong, "mid", "at", -1800, 1800).where(~F.col("found")).select("event_id", "k", "mid")


@query(
    f"""
with {EVENTS}, s as (select event_id, t, case when t - lag(t) over (order by t) <= 1800 then 0 else 1 end as new from ev where event_type = 'signup'),
b as (select *, sum(new) over (order by t) as block from s)
select block::bigint as block, count(*) as n, min(t) as start, max(t) as stop from b group by block"""
)
def cluster_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events without a pause of half an hour."""
    rows = events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "t")
    return ranges.islands(rows, "t", 1800, 86_400).groupBy("block").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("stop"))


@query()
def dedupe_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'signup'").select(F.col("event_id").alias("id"), "t", "lat", "lon")
    return catalog.greedy_clusters(rows, 1800, 150.0)


STATIONS = f"""
ev as (select n_nationkey as event_id, 27 + n_nationkey / 10.0::double as lat, 80 + n_nationkey / 5.0::double as lon from nation),
st as (select s_suppkey as station_id, 26 + (s_suppkey * 37 % 61) / 10.0::double as lat, 79 + (s_suppkey * 53 % 83) / 10.0::double as lon from supplier),
pairs as (select event_id, station_id, round({KM.format(a="e", b="s")}, 6) as km, round({AZ.format(a="e", b="s")}, 6) as azimuth from ev e, st s),
near as (select *, least(7, floor(azimuth / 45.0))::int as bin from pairs where km <= 300),
placed as (select *, row_number() over (partition by event_id, bin order by km, station_id) as place from near)"""


def station_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    ev = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("event_id"), (27 + F.col("n_nationkey") / 10.0).alias("lat"), (80 + F.col("n_nationkey") / 5.0).alias("lon"))
    st = table(spark, sf_dir, "supplier").select(k.alias("station_id"), (26 + (k * 37 % 61) / 10.0).alias("r_lat"), (79 + (k * 53 % 83) / 10.0).alias("r_lon"))
    return ranges.near(ev, st, 300.001).withColumns({"km": rounded("km"), "azimuth": rounded("azimuth")}).where("km <= 300")


@query(f"with {STATIONS} select event_id, station_id, km, azimuth, rank::int as rank from (select *, row_number() over (partition by event_id order by case when place = 1 then 0 else 1 end, km, station_id) as rank from placed) where rank <= 12")
def station_azimuth_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stations_by_azimuth(station_pairs(spark, sf_dir), "event_id", "station_id", 8, 12).select("event_id", "station_id", "km", "azimuth", "rank")


@query(f"with {STATIONS} select event_id, station_id, bin, rank::int as rank from (select *, row_number() over (partition by event_id order by place, bin) as rank from placed) where rank <= 10")
def round_robin_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.round_robin(station_pairs(spark, sf_dir), "event_id", "station_id", 8, 10).select("event_id", "station_id", "bin", "rank")


@query(f"with {STATIONS}, g as (select event_id, azimuth, coalesce(lead(azimuth) over w, min(azimuth) over (partition by event_id) + 360) - azimuth as step from near window w as (partition by event_id order by azimuth)) select event_id, count(*) as n, round(case when count(*) < 2 then 360 else max(step) end, 5)::double as gap from g group by event_id")
def azimuthal_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.azimuthal_gap(station_pairs(spark, sf_dir), "event_id").withColumn("gap", rounded("gap", 5))


@query(
    """
with acq as (select distinct o_orderpriority as track, epoch_us(o_orderdate) // 86400000000 as day from orders),
l as (select track, day as a, unnest([lead(day, 1) over w, lead(day, 2) over w]) as b from acq window w as (partition by track order by day)),
short as (select track, a, b, 'short' as kind from l where b is not null and b - a <= 36),
half as (select track, min(day) as a from acq group by track, year(date '1970-01-01' + day::int), month(date '1970-01-01' + day::int) > 6),
annual as (select track, a, arg_min(day, (abs(day - a - 365.25), day)) as b, 'annual' as kind from half join acq using (track) where abs(day - a - 365.25) <= 30 group by track, a)
select track, a, b, max(kind) as kind from (select * from short union all select * from annual) group by all"""
)
def interferogram_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros("o_orderdate") / DAY_US)
    acq = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("track"), day.alias("day")).distinct()
    return catalog.network(acq, 2, 36)


@query(
    """
with p as (select o_orderkey as id, o_custkey % 40 as path, o_orderstatus as direction, epoch_us(o_orderdate) // 86400000000 as day, case when o_orderkey % 13 > 0 then o_custkey % 7 end as frame from orders)
select a.path, a.direction, a.id as first, b.id as second, b.day - a.day as days from p a join p b on a.path = b.path and a.direction = b.direction and b.day - a.day between 1 and 24 and abs(a.frame - b.frame) <= 1"""
)
def pair_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later products of the same path and direction within 24 days and one frame; an unknown frame pairs with none."""
    frame = F.when(F.col("o_orderkey") % 13 > 0, F.col("o_custkey") % 7)
    p = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("path"), F.col("o_orderstatus").alias("direction"), F.col("o_orderkey").alias("first"), F.floor(micros("o_orderdate") / DAY_US).alias("day"), frame.alias("frame"))
    products = p.where("frame is not null").groupBy("path", "direction", "frame", "day").agg(F.collect_list("first").alias("first"))
    later = products.select("path", "direction", F.col("first").alias("second"), F.col("day").alias("later"), F.col("frame").alias("other"))
    # The products of a day go to their own frame and the two beside it, so that only those of frames that fit meet.
    beside = products.withColumn("other", F.explode(F.array(*[F.col("frame") + i for i in (-1, 0, 1)]))).drop("frame")
    pairs = ranges.within_packed(beside, later, ["path", "direction", "other"], "day", "later", "first", "second", 1, 24)
    return pairs.select("path", "direction", "first", "second", (F.col("later") - F.col("day")).alias("days"))


@query(
    f"""
with {EVENTS}, axis as (select distinct user_id, t // 86400 as day from ev where event_type in ('click', 'view')),
c as (select user_id, t // 86400 as day, sum(value) as v from ev where event_type = 'click' group by all), w as (select user_id, t // 86400 as day, count(*) as v from ev where event_type = 'view' group by all)
select user_id, day, round(c.v, 6) as clicks, c.v is not null as clicks_valid, coalesce(w.v, 255) as views, w.v is not null as views_valid from axis left join c using (user_id, day) left join w using (user_id, day)"""
)
def time_axis_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers put on the union of their times: fill values, and a flag that tells them from data."""
    ev = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    a = ev.where("event_type = 'click'").groupBy("user_id", "day").agg(F.sum("value").alias("c"))
    b = ev.where("event_type = 'view'").groupBy("user_id", "day").agg(F.count("*").alias("w"))
    axis = a.select("user_id", "day").unionByName(b.select("user_id", "day")).distinct()
    out = axis.join(a, ["user_id", "day"], "left").join(b, ["user_id", "day"], "left")
    return out.select("user_id", "day", rounded("c").alias("clicks"), F.col("c").isNotNull().alias("clicks_valid"), F.coalesce("w", F.lit(255)).cast("long").alias("views"), F.col("w").isNotNull().alias("views_valid"))


@query(
    f"""
with {EVENTS}, p as (
  select a.event_id, arg_min(b.event_id, (abs(b.t - a.t), b.t, b.event_id)) as nearest_id, min(abs(b.t - a.t)) as gap from ev a join ev b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'click' and abs(b.t - a.t) <= 86400 group by 1)
select e.event_id, e.user_id, nearest_id, gap from ev e left join p using (event_id) where e.event_type = 'purchase'"""
)
def nearest_step_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest reading of the same unit within a day, the earlier of two equally near."""
    ev = events(spark, sf_dir)
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = ev.where("event_type = 'click'").select("user_id", F.col("event_id").alias("nearest_id"), F.col("t").alias("r_t"))
    return ranges.nearest(left, right, ["user_id"], "event_id", "t", "r_t", "nearest_id", 86_400).select("event_id", "user_id", "nearest_id", "gap")


@query(
    """
with c as (select o_custkey as site, o_orderkey as id, epoch_us(o_orderdate) // 86400000000 as day, o_orderpriority as baseline, case when o_orderkey % 9 > 0 then (o_totalprice % 100) / 100 end as cloud from orders),
one as (select * from (select *, row_number() over (partition by site, day order by baseline desc, id) as r from c) where r = 1),
ranked as (select *, day < 10227 as pre, row_number() over (partition by site, day < 10227 order by cloud, day desc) as rank from one where cloud <= 0.6)
select site, case when pre then 'pre' else 'post' end as phase, id, day, round(cloud, 6) as cloud from ranked where rank <= 2"""
)
def scene_selection_pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reprocessings collapsed, then the two clearest scenes before and from the event on."""
    cloud = F.when(F.col("o_orderkey") % 9 > 0, (F.col("o_totalprice") % 100) / 100)
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("id"), F.floor(micros("o_orderdate") / DAY_US).alias("day"), F.col("o_orderpriority").alias("baseline"), cloud.alias("cloud"))
    one = ranges.first_k(c, ["site", "day"], [F.col("baseline").desc(), F.col("id").asc()], 1, "r").drop("r")
    phased = one.withColumn("phase", F.when(F.col("day") < 10_227, "pre").otherwise("post")).withColumn("key", F.concat_ws(":", "site", "phase"))
    return catalog.scenes(phased, "key", "day", "cloud", 2, 0.6).select("site", "phase", "id", "day", rounded("cloud").alias("cloud"))


@query(
    f"""
with {EVENTS}, d as (select distinct user_id as track, t // 86400 as day from ev),
g as (select track, day, day - coalesce(lag(day) over (partition by track order by day), 19722) as gap from d),
m as (select track, count(*) as n_dates, greatest(max(gap), 19753 - max(day)) as max_gap from g group by track),
s as (select track, avg(value) / 500 as sensitivity from (select user_id as track, value from ev) group by track)
select track, n_dates, max_gap, round(sensitivity, 6) as sensitivity, max_gap <= 4 as eligible, round(case when max_gap <= 4 then sensitivity * n_dates / 30 end, 6) as score from m join s using (track)"""
)
def track_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, widest gap with the window's edges, eligibility and score of each track."""
    ev = events(spark, sf_dir).select(F.col("user_id").alias("track"), F.floor(F.col("t") / 86_400).alias("day"), "value")
    days = ev.select("track", "day").distinct()
    gap = F.col("day") - F.coalesce(F.lag("day").over(Window.partitionBy("track").orderBy("day")), F.lit(19_722))
    m = days.withColumn("gap", gap).groupBy("track").agg(F.count("*").alias("n_dates"), F.greatest(F.max("gap"), 19_753 - F.max("day")).alias("max_gap"))
    out = m.join(ev.groupBy("track").agg((F.avg("value") / 500).alias("s")), "track")
    return out.select("track", "n_dates", "max_gap", rounded("s").alias("sensitivity"), (F.col("max_gap") <= 4).alias("eligible"), rounded(F.when(F.col("max_gap") <= 4, F.col("s") * F.col("n_dates") / 30)).alias("score"))


@query(
    f"""
with {EVENTS}, d as (select distinct user_id as track, t // 86400 as day from ev),
g as (select track, day, day - coalesce(lag(day) over (partition by track order by day), 19722) as gap from d),
m as (select track, count(*) as n_dates, greatest(max(gap), 19753 - max(day)) as max_gap from g group by track)
select track, n_dates, max_gap from m where max_gap <= 6 order by n_dates desc, max_gap, track limit 1"""
)
def track_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eligible track."""
    good = track_metrics(spark, sf_dir).where("max_gap <= 6")
    best = F.min(F.struct((-F.col("n_dates")).alias("n"), "max_gap", "track")).alias("b")
    return good.agg(best).where("b is not null").select("b.track", (-F.col("b.n")).alias("n_dates"), "b.max_gap")
