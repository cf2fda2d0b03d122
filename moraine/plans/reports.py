"""Corridor features, calendars, evaluation summaries, index rows, station rows and tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators import corridors, evaluate, watch
from moraine.plans.base import query, rounded
from moraine.plans.evaluation import SCORED, scored
from moraine.plans.hazard import CELLS, profile
from moraine.plans.rules import event_records
from moraine.sources import readers
from moraine.tables import table


@query(
    f"""
with {CELLS}, p as (select run, bin, coalesce(case when bin % 10 <> 3 then min_bed end, max(case when bin % 10 <> 3 then min_bed end) over (partition by run), 0) as z from profile),
w as (select *, lag(z) over o as b, lead(z) over o as a, min(z) over (partition by run) as lo, max(z) over (partition by run) as hi, max(z) over (partition by run order by bin rows between 6 preceding and 6 following) as top, max((bin + 0.5) * 250.0::double) over (partition by run) as far from p window o as (partition by run order by bin))
select run, bin, round((z - lo) / greatest(hi - lo, 1), 9) as bed, round(greatest(-1, least(1, -(case when b is null then a - z when a is null then z - b else (a - b) / 2 end) / 250)), 9) as slope, round(greatest(0, least(5, (top - z) / 100)), 9) as confinement, round((bin + 0.5) * 250.0::double / greatest(far, 1), 9) as place from w"""
)
def corridor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bed, slope, confinement and place of each bin, unknown beds filled with the greatest."""
    rows = profile(spark, sf_dir).select("run", "bin", F.when(F.col("bin") % 10 != 3, F.col("min_bed")).alias("bed"))
    return corridors.features(rows, ["run"], 250.0).withColumns({c: rounded(c, 9) for c in ("bed", "slope", "confinement", "place")})


@query(f"with {CELLS}, d as (select run, min_bed - lag(min_bed) over (partition by run order by bin) as d from profile) select run, round(greatest(coalesce(max(d), 0), 0), 6) as rise, greatest(coalesce(max(d), 0), 0) <= 30 as drains from d group by run")
def corridor_drainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest rise of each corridor's bed, and whether it drains within a tolerance."""
    return corridors.rises(profile(spark, sf_dir).withColumnRenamed("min_bed", "bed"), ["run"], 30.0).withColumn("rise", rounded("rise"))


@query()
def corridor_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chainage and offset of points against a winding centreline; the nearest segment isn't SQL."""
    line = [(250.0 * k, 400.0 * ((k * 7) % 5 - 2)) for k in range(41)]
    k = F.col("l_partkey")
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (k * 13 % 10_000).cast("double").alias("x"), (k * 29 % 3_000 - 1500).cast("double").alias("y"))
    return corridors.project(points, line)


@query("select o_custkey as id, unnest(range(date_trunc('month', min(o_orderdate) + interval 1 month - interval 1 day)::timestamp, max(o_orderdate)::timestamp + interval 1 microsecond, interval 1 month))::date as step from orders group by o_custkey")
def month_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each month within each customer's orders."""
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("id", F.explode(watch.month_starts(F.to_date("a"), F.to_date("b"))).alias("step"))


@query(
    f"""
with {SCORED}, x as (select case when truth = 1 then 1 else 0 end + toxic as t, case when p >= 0.7 then 2 when p >= 0.35 then 1 else 0 end as g from scored)
select t::int as truth, count(*) filter (where g = 0) as p0, count(*) filter (where g = 1) as p1, count(*) filter (where g = 2) as p2 from (select unnest(range(3)) as t) c left join x using (t) group by t"""
)
def confusion_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three true classes by three predicted ones, empty cells as zeros."""
    rows = scored(spark, sf_dir).select((F.when(F.col("truth") == 1, 1).otherwise(0) + F.col("toxic")).alias("truth"), F.when(F.col("p") >= 0.7, 2).when(F.col("p") >= 0.35, 1).otherwise(0).alias("predicted"))
    return evaluate.confusion(rows, "truth", "predicted", 3)


@query(
    f"""
with {SCORED}, b as (select least(9, len(list_filter(range(1, 10), lambda k: p >= k * 0.1::double))) as bin, p, truth from scored), g as (select bin, count(*) as n, avg(p) as c, avg(truth) as a from b group by bin)
select (select count(*) from scored) as n, round((select avg((p - truth) ** 2) from scored), 9) as brier, round(sum(n * abs(c - a)) / sum(n), 9) as ece from g"""
)
def reliability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and expected calibration error."""
    out = evaluate.calibration_error(evaluate.reliability(scored(spark, sf_dir), "p", F.col("truth") == 1))
    return out.withColumns({c: rounded(c, 9) for c in ("brier", "ece")})


@query(
    """
select doc_id as event_id, case doc_id % 16 when 0 then 'negative_control' when 1 then 'co_seismic_reference' when 2 then 'evacuation_counterfactual' else 'reference' end as role, n_chars::double as volume_low, (n_chars + 9)::double as volume_high, case when doc_id % 3 = 0 then n_chars + 1 end::double as volume_best,
  case when doc_id % 5 > 0 then doc_id end::double as runout_low, case when doc_id % 5 > 0 then doc_id + 9 end::double as runout_high, null::double as runout_best, 2 as n_sources, sha256(doc_id::varchar) as json_sha256 from documents"""
)
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as wide rows."""
    records = event_records(spark, sf_dir).withColumn("document", F.col("event_id").cast("string"))
    return readers.index_rows(records, "event_id", ["role"], "ranges", {"volume": "volume", "runout": "runout"}, "sources", "document")


@query(
    """
select 'N' || n_nationkey || '.S' || s_suppkey || '.' || case when i = 1 then '10' else '' end || '.HH' || ['Z', 'N'][i + 1] as key, s_suppkey as id, case when s_suppkey % 3 > 0 then 100.0::double end as rate_hz, n_nationkey % 2 = 1 as is_restricted,
  round(2 * 6371.0088::double * asin(sqrt(least(1, sin(radians(la - 30) / 2) ** 2 + cos(radians(30)) * cos(radians(la)) * sin(radians(lo - 79) / 2) ** 2))), 6) as distance_km
from (select *, (s_suppkey % 120 - 60)::double as la, (s_suppkey % 300 - 150)::double as lo from supplier join nation on s_nationkey = n_nationkey), (select unnest(range(2)) as i)"""
)
def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks, stations and channels as one row a channel, with the distance from a source."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    channel = lambda code, location: F.struct(F.lit(code).alias("code"), F.lit(location).cast("string").alias("location"), (k % 120 - 60).cast("double").alias("latitude"), (k % 300 - 150).cast("double").alias("longitude"), k.cast("double").alias("elevation"), F.when(k % 3 > 0, 100.0).otherwise(0.0).alias("rate"))
    stations = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("n_nationkey", F.struct(F.concat(F.lit("S"), k.cast("string")).alias("code"), F.array(channel("HHZ", None), channel("HHN", "10")).alias("channels")).alias("station"))
    nets = stations.groupBy("n_nationkey").agg(F.collect_list("station").alias("stations")).select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.when(F.col("n_nationkey") % 2 == 1, "closed").otherwise("open").alias("restricted"), "stations")
    out = readers.station_rows(nets, "centre", (30.0, 79.0))
    return out.select("key", F.substring("station", 2, 20).cast("long").alias("id"), "rate_hz", "is_restricted", rounded("distance_km").alias("distance_km"))


@query(
    """
with c as (select o_orderpriority as p, o_orderstatus as s, count(*) as n from orders group by all),
r as (select p, '| ' || p || ' | ' || coalesce(max(n) filter (where s = 'F')::varchar, '-') || ' | ' || coalesce(max(n) filter (where s = 'O')::varchar, '-') || ' | ' || coalesce(max(n) filter (where s = 'X')::varchar, '-') || ' |' as line from c group by p)
select line from r union all select '| priority | F | O | X |' union all select '|---|---|---|---|'"""
)
def markdown_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of counts as lines of a Markdown table."""
    cells = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return readers.markdown_lines(cells, ["priority"], "status", ["F", "O", "X"], "n").select("line")


@query()
def flooded_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depressions of a grid filled towards its outlet; a flood isn't SQL."""
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.floor(k / 40).alias("r"), (k % 40).alias("c"), (F.col("p_retailprice") + k * 31 % 97).alias("z"), (F.floor(k / 40) == 0).alias("seed"))
    return corridors.flood(cells, 0.01, 32)
