"""Texts, hashes, envelopes, contracts, signals, graphs, inversions and the detector's batch twin."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import hazard, signal, text
from moraine.functions import quantiles as Q
from moraine.operators import contracts, evaluate, graph, grids, inversion, waveforms
from moraine.plans.base import DAY_US, micros, query, rounded
from moraine.streaming import detector
from moraine.streaming import windows as station_windows_
from moraine.tables import table

COLLAPSED = "nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"
UNESCAPED = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(
    "select page_id, "
    + COLLAPSED.format(x=UNESCAPED.format(x="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
    + " as title, sha256(html) as html_sha256, lower(trim(split_part('Text/HTML; charset=utf-8', ';', 1))) as media, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages"
)
def source_titles_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = text.media_type(F.lit("Text/HTML; charset=utf-8"))
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), F.sha2("html", 256).alias("html_sha256"), media.alias("media"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))


@query(
    """
with t as (select distinct conv_id, turn, role from conversations),
l as (select conv_id, turn, role, lag(turn) over (partition by conv_id order by turn, role) as before, first(role) over (partition by conv_id order by turn, role) as starter from t)
select conv_id, turn, role, case when before is not null then conv_id || ':' || before end as causation_id, before is not null and turn - before > 1 as gap, starter from l"""
)
def envelope_causation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message with the one that caused it, and whether the sequence has a gap before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct().withColumns({"before": F.lag("turn").over(w), "starter": F.first("role").over(w)})
    cause = F.when(F.col("before").isNotNull(), F.concat_ws(":", "conv_id", "before"))
    return rows.select("conv_id", "turn", "role", cause.alias("causation_id"), (F.col("before").isNotNull() & (F.col("turn") - F.col("before") > 1)).alias("gap"), "starter")


@query(
    """
with r as (
  select l_orderkey as id, l_linenumber as line, unnest([case when l_shipdate < o_orderdate then 'ships before order' end, case when l_discount > 0.09 and l_tax > 0.07 then 'discount with tax' end, case when l_quantity * 1000 > l_extendedprice * 10 then 'price too low' end,
    case when o_orderstatus = 'F' and l_linestatus <> 'F' then 'final order with open line' end, case when o_orderkey is null then 'unknown order' end]) as rule
  from lineitem left join orders on l_orderkey = o_orderkey)
select rule, count(*) as n, count(distinct id) as n_ids from r where rule is not null group by rule"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and records break each rule."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"], "left")
    rules = {
        "ships before order": F.col("l_shipdate") < F.col("o_orderdate"),
        "discount with tax": (F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07),
        "price too low": F.col("l_quantity") * 1000 > F.col("l_extendedprice") * 10,
        "final order with open line": (F.col("o_orderstatus") == "F") & (F.col("l_linestatus") != "F"),
        "unknown order": F.col("o_orderkey").isNull(),
    }
    return contracts.violations(rows, ["l_orderkey"], rules).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_ids"))


def _nested(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Orders as nested records, with nulls; the later version differs in places."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 11 > 0, F.floor("o_totalprice").cast("long") + (F.when(k % 17 == 0, 1).otherwise(0) if later else 0))
    status = F.when(k % (5 if later else 7) > 0, F.col("o_orderstatus"))
    return o.select(k.alias("id"), F.struct(price.alias("price"), status.alias("status")).alias("body"), F.struct(F.struct(F.col("o_orderpriority").alias("priority")).alias("inner"), F.when(k % 3 > 0, k).alias("seen_at")).alias("meta"))


NESTED = """
o as (select o_orderkey as k, floor(o_totalprice)::bigint as p, o_orderstatus as s, o_orderpriority as r from orders),
a as (select k as id, unnest(['body.price', 'body.status', 'meta.inner.priority', 'meta.seen_at']) as path, unnest([case when k % 11 > 0 then p::varchar end, case when k % 7 > 0 then s end, r, case when k % 3 > 0 then k::varchar end]) as v from o),
b as (select k as id, unnest(['body.price', 'body.status', 'meta.inner.priority', 'meta.seen_at']) as path, unnest([case when k % 11 > 0 then (p + case when k % 17 = 0 then 1 else 0 end)::varchar end, case when k % 5 > 0 then s end, r, case when k % 3 > 0 then k::varchar end]) as v from o)"""


@query(f"with {NESTED} select path, count(*) filter (where v is null) as n_null, count(v) as n_known from a group by path")
def record_walk_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of every leaf path of nested records."""
    rows = contracts.leaves(_nested(spark, sf_dir, False), ["id"])
    return rows.groupBy("path").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count("value").alias("n_known"))


@query(f"with {NESTED} select a.id, path, case when a.v is null then 'added' when b.v is null then 'removed' else 'changed' end as kind from a join b using (id, path) where a.v is distinct from b.v and not path like '%\\_at' escape '\\'")
def record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.record_diff(_nested(spark, sf_dir, False), _nested(spark, sf_dir, True), ["id"], text.is_volatile(F.col("path")))


@query(
    """
with x as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings where embedding is not null),
e as (select vec_id, i, sum(abs(v)) over (partition by vec_id order by i rows between 2 preceding and 2 following) / 5.0 as env from x),
p as (select vec_id, i, env, max(env) over (partition by vec_id) as peak from e)
select vec_id, count(*) filter (where env > 0.5 * peak) as n_above, min(i) filter (where env >= 0.5 * peak) - min(i) filter (where env >= 0.1 * peak) as rise, round(any_value(peak), 6) as peak from p group by vec_id"""
)
def envelope_duration_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving-average envelope, zeros beyond the ends; time above half of its peak, and rise from 10 to 50 %."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    w = Window.partitionBy("vec_id")
    e = x.withColumn("env", F.sum(F.abs(F.col("v").cast("double"))).over(w.orderBy("i").rowsBetween(-2, 2)) / 5.0).withColumn("peak", F.max("env").over(w))
    first = lambda share: F.min(F.when(F.col("env") >= share * F.col("peak"), F.col("i"))).cast("long")
    return e.groupBy("vec_id").agg(F.count_if(F.col("env") > 0.5 * F.col("peak")).alias("n_above"), (first(0.5) - first(0.1)).alias("rise"), rounded(F.max("peak")).alias("peak"))


@query(
    """
with x as (select vec_id, label, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings),
c as (select a.label, a.vec_id as p, b.vec_id as q, corr(a.v, b.v) as r from x a join x b on a.label = b.label and a.vec_id < b.vec_id and a.i = b.i group by all)
select label, count(*) as n_pairs, round(avg(r), 6) as coherence from c group by label"""
)
def pairwise_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation over all pairs of a group, from the sum of unit vectors: no pair is formed."""
    return signal.mean_pair_correlation(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("coherence", rounded("coherence"))


@query()
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    third = lambda k: F.slice(e, k * 21 + 1, 21)
    s = signal.spectrum_udf(1.0)(e)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", signal.band_ratio_udf(1.0, (0.01, 0.1), (0.2, 0.5))(e).alias("ratio"), s.alias("s"), signal.rectilinearity_udf()(third(0), third(1), third(2)).alias("rectilinearity"))
    return rows.select("vec_id", "ratio", "s.*", "rectilinearity")


@query()
def normal_equations_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damped solutions of the summed equations of all traces; the data is the signal reversed."""
    traces = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("kernel"), F.reverse("embedding").alias("data")).where("kernel is not null")
    found = inversion.solve(inversion.normal_equations(traces, 6), 6, (1e-3, 1e-2, 1e-1, 1.0))
    return spark.createDataFrame([(float(d), k, float(x)) for d, s in found for k, x in enumerate(s)], "damping double, basis int, value double")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    a = s.select(k.alias("src"), F.floor((k + 5) / 2).alias("dst"), (1 + k % 7).cast("double").alias("length"))
    b = s.where("s_suppkey % 10 < 3").select(k.alias("src"), (k + 10).alias("dst"), (2 + k % 5).cast("double").alias("length"))
    return a.unionByName(b).where("src <> dst")


@query(
    """
with recursive e as (
  select s_suppkey as src, (s_suppkey + 5) // 2 as dst from supplier union all select s_suppkey, s_suppkey + 10 from supplier where s_suppkey % 10 < 3),
b as (select src, dst from e where src <> dst union all select dst, src from e where src <> dst),
r as (select distinct src as node, src as seen from b union select r.node, b.dst from r join b on r.seen = b.src)
select node, min(seen) as component from r group by node"""
)
def river_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir)).select("node", "component")


@query()
def river_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(_edges(spark, sf_dir), 4)


RATE = 4.0


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks of their label's channel, 16 s each; seven seconds are missing after every twenty. Every fifth chunk swings slowly."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("n", n)
    slow = F.transform("embedding", lambda x, i: x.cast("double") + F.when(F.floor(F.col("n") / 5) % 2 == 0, 3 * F.sin((F.col("n") * 64 + i) * 0.1)).otherwise(0.0))
    start = (F.col("n") * 16 + F.floor(F.col("n") / 20) * 7) * 1_000_000
    return rows.select(F.col("label").alias("channel"), start.alias("start_us"), F.lit(RATE).alias("rate"), slow.alias("samples"))


@query()
def detector_stub_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ratio that the streaming detector computes over the same chunks, and which of them fire."""
    return detector.ratios_batch(_chunks(spark, sf_dir), detector.DetectorConfig(high=(0.5, 2.0), ratio=5.0))


GOLDEN = """
with a as (select event_type || '.' || lpad(user_id::varchar, 4, '0') as channel, epoch_us(ts) // 86400000000 as end_us, count(*) as n_samples, sum(value) as ratio, user_id, event_type from events group by all),
k as (select channel, end_us, (user_id * 31 + end_us * 17 + length(event_type)) % 97 as h from a)"""


@query(
    GOLDEN
    + """
select channel, end_us, case h when 0 then 'missing' when 1 then 'not expected' when 2 then 'count' when 3 then 'fired' else 'ratio' end as problem from k where h < 5 order by channel, end_us limit 10"""
)
def golden_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten differences of a run from the expected one, into which differences of every kind are planted: rows of one only, counts, fires, ratios; one within the tolerance is none."""
    day = F.floor(micros("ts") / DAY_US)
    own = table(spark, sf_dir, "events").groupBy("user_id", "event_type", day.alias("end_us")).agg(F.count("*").alias("n_samples"), F.sum("value").alias("ratio"))
    channel = F.concat(F.col("event_type"), F.lit("."), F.lpad(F.col("user_id").cast("string"), 4, "0"))
    rows = own.withColumns({"channel": channel, "fired": F.col("ratio") > 100, "h": (F.col("user_id") * 31 + F.col("end_us") * 17 + F.length("event_type")) % 97})
    h = F.col("h")
    expected = rows.where(h != 1).select("channel", "end_us", "n_samples", "ratio", "fired")
    off = F.when(h == 4, 1 + 1e-4).when(h == 5, 1 + 1e-9).otherwise(1.0)
    actual = rows.where(h != 0).select("channel", "end_us", (F.col("n_samples") + F.when(h == 2, 1).otherwise(0)).alias("n_samples"), (F.col("ratio") * off).alias("ratio"), (F.col("fired") != (h == 3)).alias("fired"))
    return detector.golden_differences(expected, actual)


def named_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of ``_chunks`` as those of four stations of up to three components."""
    k = F.col("channel").cast("int")
    name = F.concat(F.lit("NW.S"), F.floor(k / 3).cast("string"), F.lit(".00.HH"), F.substring(F.lit("ZNE"), k % 3 + 1, F.lit(1)))
    place = F.row_number().over(Window.partitionBy("channel").orderBy("start_us"))
    return _chunks(spark, sf_dir).select(F.lit("all").alias("group"), "start_us", name.alias("channel"), place.alias("sequence"), "rate", "samples")


@query()
def window_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window that the detector of many stations scores over the chunks in order, and which of them fire."""
    config = station_windows_.WindowConfig(cut=waveforms.Cut(rate=RATE, seconds=128.0, band=(0.02, 1.8)), needed_s=64.0, stride_s=30.0, cooldown_s=100.0)
    score = partial(station_windows_.low_share, rate=RATE, low=(0.02, 0.3), high=(0.5, 1.8))
    return station_windows_.detections_batch(named_chunks(spark, sf_dir), config, score)


@query()
def station_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 56 s of each station, merged from four overlapping traces a component, with what is valid and why the rest isn't."""
    n = F.col("sequence") - 1
    rows = named_chunks(spark, sf_dir).select(F.regexp_extract("channel", r"^(\w+\.\w+)", 1).alias("station"), F.floor(n / 4).alias("window"), "channel", "rate", ((n % 4) * 14.0).alias("offset_s"), "samples")
    out = waveforms.station_windows(rows, ["station", "window"], waveforms.Cut(rate=RATE, seconds=56.0, band=(0.02, 1.8)))
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return out.select("station", "window", F.size("samples").alias("n"), "valid", "dropped", rounded(energy, 3).alias("energy"))


@query()
def damping_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misfit and norm of each damping of the summed equations of all traces, and which one lies at the curve's corner."""
    traces = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("kernel"), F.reverse("embedding").alias("data")).where("kernel is not null")
    dampings = tuple(10.0 ** (k / 2) for k in range(-10, 5))
    equations = inversion.normal_equations(traces, 6)
    energy = traces.agg(F.sum(F.aggregate("data", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0.0
    full = np.zeros((6, 7))
    for i, j, value in equations.collect():  # 42 sums
        full[i, j] = value
    found = inversion.solve(equations, 6, dampings)
    misfits = [max(0.0, energy - 2 * x @ full[:, 6] + x @ full[:, :6] @ x) ** 0.5 for _, x in found]
    norms = [float(np.sqrt(x @ x)) for _, x in found]
    best = inversion.corner(misfits, norms)
    return spark.createDataFrame([(d, float(m), n, k == best) for k, ((d, _), m, n) in enumerate(zip(found, misfits, norms))], "damping double, misfit double, norm double, corner boolean")


@query(
    """
with m as (select event_id as id, case when event_id % 11 = 0 then 'no json' when event_id % 13 = 0 then '{"schema_version": "1.0.0"}' else 'x' end as raw, case event_id % 5 when 0 then 'detection' when 1 then 'other' else 'waveform' end as name, case event_id % 7 when 0 then '2.1.0' when 1 then 'x' else '1.4.0' end as version, event_id % 17 = 0 as bad from events)
select case when raw = 'no json' then 'malformed envelope' when raw <> 'x' then 'schema_name or schema_version missing' when name = 'other' then 'unknown schema' when version = 'x' then 'malformed schema_version' when version = '2.1.0' then 'major version mismatch' when bad then 'payload does not satisfy its schema' else 'none' end as problem, count(*) as n from m group by 1"""
)
def decoded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes by what is wrong with them."""
    k = F.col("event_id")
    name = F.when(k % 5 == 0, "detection").when(k % 5 == 1, "other").otherwise("waveform")
    version = F.when(k % 7 == 0, "2.1.0").when(k % 7 == 1, "x").otherwise("1.4.0")
    payload = F.when(k % 17 == 0, F.lit("5")).otherwise(F.to_json(F.struct("user_id", "value")))
    good = F.concat(F.lit('{"schema_name":"'), name, F.lit('","schema_version":"'), version, F.lit('","payload":'), payload, F.lit("}"))
    raw = F.when(k % 11 == 0, "no json").when(k % 13 == 0, '{"schema_version": "1.0.0"}').otherwise(good)
    registry = {"detection": ("1.0.0", "user_id long, value double"), "waveform": ("1.2.0", "user_id long")}
    out = detector.decoded(table(spark, sf_dir, "events").select(raw.alias("raw")), registry)
    return out.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(
    """
with s as (select (epoch_us(ts) // 1000000) as t, user_id from events), w as (select user_id, t, unnest(range((t // 21600) * 21600 - 64800, (t // 21600) * 21600 + 1, 21600)) as start from s)
select start::bigint as start, count(distinct user_id) as n_channels, count(*) as n_chunks from w where t >= start and t < start + 86400 group by start having count(distinct user_id) >= 90"""
)
def multi_station_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-long windows every six hours in which enough channels have data."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    out = detector.windows_with_stations(rows, "86400 seconds", "21600 seconds", 90)
    return out.select(F.floor(micros("start") / 1_000_000).alias("start"), "n_channels", "n_chunks")


@query(
    """
with c as (select event_type as mode, user_id as channel, epoch_us(ts) // 1000000 as t, event_id from events),
s as (select *, max(t + event_id % 40) over (partition by mode order by t, channel, event_id) as stream_time from c),
l as (select mode, list(stream_time - t order by stream_time - t) as d, min(stream_time) filter (where event_id % 50 = 7) as fired from s group by mode)
select mode, len(d) as n, fired, d[least(len(d) - 1, len(d) // 2) + 1] as p50, d[least(len(d) - 1, floor(0.95::double * len(d))::bigint) + 1] as p95 from l"""
)
def replay_latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay behind the running maximum of chunk ends, picked by index, and the first fire of each mode.

    Running maxima are taken per hour and over the hours before, so a mode is spread over tasks;
    delays are counted by value before they are ranked.
    """
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("user_id").alias("channel"), F.floor(micros("ts") / 1_000_000).alias("t"), "event_id")
    c = c.withColumns({"hour": F.floor(F.col("t") / 3600), "end": F.col("t") + F.col("event_id") % 40})
    before = Window.partitionBy("mode").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = c.groupBy("mode", "hour").agg(F.max("end").alias("top")).withColumn("top", F.max("top").over(before))
    inside = Window.partitionBy("mode", "hour").orderBy("t", "channel", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = c.withColumn("own", F.max("end").over(inside)).join(hours, ["mode", "hour"]).withColumn("stream", F.greatest("own", "top"))
    s = s.select("mode", (F.col("stream") - F.col("t")).alias("delay"), F.when(F.col("event_id") % 50 == 7, F.col("stream")).alias("fire"))
    first = s.groupBy("mode").agg(F.count("*").alias("n"), F.min("fire").alias("fired"))
    ranked = evaluate.counts_below(s.groupBy("mode", "delay").agg(F.count("*").alias("c")), ["mode"], "delay", ["c"]).join(first, "mode")
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))
    pick = lambda q: F.max(F.when((F.col("c_below") <= at(q)) & (at(q) < F.col("c_below") + F.col("c")), F.col("delay")))
    return ranked.groupBy("mode", "n", "fired").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query(
    """
select (epoch_us(o_orderdate) // 86400000000)::bigint as day, count(*) as n, count(distinct o_orderpriority) as n_levels, count(distinct o_orderpriority) > 1 as mixed from orders
where month(o_orderdate) * 100 + day(o_orderdate) >= 1101 or month(o_orderdate) * 100 + day(o_orderdate) <= 228 group by 1"""
)
def season_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days within a season that wraps over new year, and whether they mix levels."""
    rows = table(spark, sf_dir, "orders").where(hazard.in_season(F.col("o_orderdate"), (11, 1), (2, 28)))
    levels = F.count_distinct("o_orderpriority")
    return rows.groupBy(F.floor(micros("o_orderdate") / DAY_US).alias("day")).agg(F.count("*").alias("n"), levels.alias("n_levels"), (levels > 1).alias("mixed"))


@query(
    """
with k as (select p_partkey as id, 50 + p_size * 5.0::double as slope, p_retailprice / 100 as depth, p_size / 50.0::double as mu from part)
select id, round(sqrt(greatest(0, 400 * depth * (sin(radians(slope)) - mu * cos(radians(slope))))), 6) as velocity, round(greatest(9.81 * sin(radians(slope)) * (1 - mu), 0.05), 6) as acceleration,
  round(case when id - 1000 <= -sqrt(9.81 * 10) * 20 then 10 when id - 1000 >= 2 * sqrt(9.81 * 10) * 20 then 0 else (2 * sqrt(9.81 * 10) - (id - 1000) / 20.0::double) ** 2 / (9 * 9.81) end, 6)::double as dam_break,
  round(greatest(0.9 * (depth - 12), -0.1 * (depth - 12)), 6) as pinball from k"""
)
def solver_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed forms that a solver is held against, and the quantile loss."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (50 + F.col("p_size") * F.lit(5.0)).alias("slope"), (F.col("p_retailprice") / 100).alias("depth"), (F.col("p_size") / F.lit(50.0)).alias("mu"))
    return k.select(
        "id",
        rounded(hazard.terminal_velocity(F.col("depth"), F.radians("slope"), F.col("mu"), F.lit(400.0))).alias("velocity"),
        rounded(hazard.effective_acceleration(F.col("slope"), F.col("mu"))).alias("acceleration"),
        rounded(hazard.dam_break_depth((F.col("id") - 1000).cast("double"), F.lit(20.0), 10.0)).alias("dam_break"),
        rounded(hazard.pinball(F.lit(12.0), F.col("depth"), 0.9)).alias("pinball"),
    )


@query(
    """
with g as (select p_partkey // 40 as r, p_partkey % 40 as c, p_retailprice as v from part),
p as (select s_suppkey as id, (s_suppkey * 7 % 30) + 0.25::double as y, (s_suppkey * 13 % 41) + 0.5::double as x from supplier),
k as (select id, floor(y)::bigint + i as r, floor(x)::bigint + j as c, (case i when 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case j when 1 then x - floor(x) else 1 - (x - floor(x)) end) as w from p, (values (0), (1)) a(i), (values (0), (1)) b(j))
select id, round(case when count(v) = count(*) then sum(w * v) end, 6) as value from k left join g using (r, c) group by id"""
)
def bilinear_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field read between its cells; points beyond it are null."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    field = table(spark, sf_dir, "part").select(F.floor(k / 40).alias("r"), (k % 40).alias("c"), F.col("p_retailprice").alias("value"))
    points = table(spark, sf_dir, "supplier").select(s.alias("id"), ((s * 7 % 30) + 0.25).cast("double").alias("y"), ((s * 13 % 41) + 0.5).cast("double").alias("x"))
    return grids.bilinear(points, field).withColumn("value", rounded("value"))


@query()
def chip_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts between a chip and the same chip moved by one row and two columns."""
    e = F.col("embedding")
    moved = F.concat(F.slice(e, 55, 10), F.slice(e, 1, 54))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", signal.match_chip_udf(8, 3)(e, moved).alias("m"))
    return rows.select("vec_id", "m.*")
