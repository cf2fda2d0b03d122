"""Record contracts: how many records break each rule, for every kind of record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators import contracts, rules
from moraine.plans.base import micros, query, rounded
from moraine.tables import table


def _counted(records: str, conditions: dict[str, str]) -> str:
    """SQL: records (a select) and the condition of each rule."""
    found = ", ".join(f"case when {c} then '{name.replace(chr(39), chr(39) * 2)}' end" for name, c in conditions.items())
    return f"with r as ({records}), f as (select unnest([{found}]) as rule from r) select rule, count(*) as n from f where rule is not null group by rule"


def _count(records: DataFrame, broken: dict[str, Column], key: str = "id") -> DataFrame:
    return contracts.violations(records, [key], broken).groupBy("rule").agg(F.count("*").alias("n"))


# Ledger rows

LEDGER = """
select o_orderkey as id, case o_orderkey % 7 when 0 then 'synthetic' when 1 then 'listed' when 2 then 'not_fetched' when 3 then 'dry_run' else 'fetched' end as status,
  case when o_orderkey % 7 in (0, 3) and o_orderkey % 5 > 0 or o_orderkey % 41 = 0 then 'synthetic' else 'real' end as provenance,
  case when o_orderkey % 11 > 0 then case when o_orderkey % 7 = 0 and o_orderkey % 3 > 0 then 'tests/fixtures/synthetic/' else 'data/raw/' end || o_orderkey end as path,
  case when o_orderkey % 13 > 0 then sha256(o_orderkey::varchar) end as sha256, case when o_orderkey % 17 > 0 then o_custkey end as size_bytes, case when o_orderkey % 19 > 0 then o_orderdate end as retrieved_at,
  case when o_orderkey % 4 > 0 then 'a synthetic placeholder' end as notes, o_orderdate as time_start, case when o_orderkey % 23 = 0 then o_orderdate - interval 1 day else o_orderdate + interval 1 day end as time_end,
  [(o_custkey % 400) - 200, -10, (o_custkey % 400) - 190, 10 + o_orderkey % 90]::double[] as bbox from orders"""


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 7 == 0, "synthetic").when(k % 7 == 1, "listed").when(k % 7 == 2, "not_fetched").when(k % 7 == 3, "dry_run").otherwise("fetched")
    made = ((k % 7).isin(0, 3) & (k % 5 > 0)) | (k % 41 == 0)
    folder = F.when((k % 7 == 0) & (k % 3 > 0), rules.SYNTHETIC_FOLDER).otherwise("data/raw/")
    day = F.expr("interval 1 day")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), status.alias("status"), F.when(made, "synthetic").otherwise("real").alias("provenance"), F.when(k % 11 > 0, F.concat(folder, k.cast("string"))).alias("path"),
        F.when(k % 13 > 0, F.sha2(k.cast("string"), 256)).alias("sha256"), F.when(k % 17 > 0, c).alias("size_bytes"), F.when(k % 19 > 0, at).alias("retrieved_at"), F.when(k % 4 > 0, "a synthetic placeholder").alias("notes"),
        at.alias("time_start"), F.when(k % 23 == 0, at - day).otherwise(at + day).alias("time_end"), F.array((c % 400 - 200).cast("double"), F.lit(-10.0), (c % 400 - 190).cast("double"), (10 + k % 90).cast("double")).alias("bbox"),
    )


@query(
    _counted(
        LEDGER,
        {
            **{f"fetched without {x}": f"status = 'fetched' and {x} is null" for x in ("path", "sha256", "size_bytes", "retrieved_at")},
            "status synthetic, provenance not": "status = 'synthetic' and provenance <> 'synthetic'",
            "provenance synthetic, status not": "provenance = 'synthetic' and status not in ('synthetic', 'dry_run')",
            "synthetic outside its folder": "provenance = 'synthetic' and path is not null and not starts_with(path, 'tests/fixtures/synthetic/')",
            "synthetic without notes": "provenance = 'synthetic' and coalesce(notes, '') = ''",
            "synthetic under data": "provenance = 'synthetic' and starts_with(path, 'data/')",
            "ends before it starts": "time_end < time_start",
            "box out of order": "not (bbox[1] >= -180 and bbox[1] <= bbox[3] and bbox[3] <= 180 and bbox[2] >= -90 and bbox[2] <= bbox[4] and bbox[4] <= 90)",
        },
    )
)
def ledger_entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(ledger_rows(spark, sf_dir), rules.ledger_entry())


@query(
    f"""
with e as ({LEDGER}),
f as (select case when o_orderkey % 9 = 0 then 'tests/fixtures/synthetic/' || case when o_orderkey % 2 = 0 then 'stray' || o_orderkey else o_orderkey || '/README.md' end else case when o_orderkey % 7 = 0 and o_orderkey % 3 > 0 then 'tests/fixtures/synthetic/' else 'data/raw/' end || o_orderkey end as path,
    sha256((o_orderkey + case when o_orderkey % 29 = 0 then 1 else 0 end)::varchar) as fsha, o_custkey as fsize from orders where o_orderkey % 31 > 0),
b as (select *, status in ('fetched', 'listed', 'synthetic') as kept, fsha is not null as file, provenance = 'synthetic' as made, starts_with(path, 'tests/fixtures/synthetic/') as inside
  from (select * from e where path is not null) e full join f using (path)),
x as (select unnest([case when kept and not file then 'file is missing' end, case when kept and file and (sha256 is null or size_bytes is null) then 'no hash or size recorded' end,
    case when kept and file and (sha256 <> fsha or size_bytes <> fsize) then 'bytes differ' end, case when status in ('not_fetched', 'requested', 'failed') and file then 'file of a row without one' end,
    case when status is not null and inside and not made then 'real row in the synthetic folder' end, case when starts_with(path, 'data/') and (made or status = 'synthetic') then 'synthetic row under data' end,
    case when made and (not contains(lower(coalesce(notes, '')), 'synthetic') or status <> 'synthetic') then 'synthetic row not labelled' end,
    case when file and inside and not coalesce(status is not null and made, false) and not split_part(path, '/', -1) in ('FIXTURES.md', '.gitkeep', 'README.md', 'manifest.json') then 'file not recorded' end]) as rule from b)
select rule, count(*) as n from x where rule is not null group by rule"""
)
def ledger_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files hashed again and held against the ledger, one full join by path."""
    k = F.col("o_orderkey")
    folder = F.when((k % 7 == 0) & (k % 3 > 0), rules.SYNTHETIC_FOLDER).otherwise("data/raw/")
    name = F.when(k % 9 == 0, F.concat(F.lit(rules.SYNTHETIC_FOLDER), F.when(k % 2 == 0, F.concat(F.lit("stray"), k)).otherwise(F.concat(k, F.lit("/README.md"))))).otherwise(F.concat(folder, k))
    files = table(spark, sf_dir, "orders").where(k % 31 > 0).select(name.alias("path"), F.sha2((k + F.when(k % 29 == 0, 1).otherwise(0)).cast("string"), 256).alias("sha256"), F.col("o_custkey").alias("size_bytes"))
    return rules.ledger_files(ledger_rows(spark, sf_dir), files).groupBy("rule").agg(F.count("*").alias("n"))


# Chunks, detections, states, losses and reports

TRACE = """
select doc_id as id, doc_id * 1000000 as start_us, strlen(text) // 4 + case when doc_id % 6 = 0 then 1 else 0 end as npts, (10 + doc_id % 40)::double as rate_hz, encode(text) as data, case when doc_id % 8 = 0 then sha256('other') else sha256(text) end as data_sha256,
  case when doc_id % 3 = 0 then 'float32le' else 'steim2' end as encoding, doc_id * 1000000 + ((strlen(text) // 4 - 1) * 1e6 / (10 + doc_id % 40) + (doc_id % 5) * 40000)::bigint as end_us from documents where text is not null"""


@query(
    _counted(
        TRACE,
        {
            "end doesn't follow": "abs(end_us - (start_us + (npts - 1) * 1e6::double / rate_hz)) > 1e6::double / rate_hz",
            "hash differs": "sha256(data) <> data_sha256",
            "length differs": "encoding = 'float32le' and octet_length(data) <> 4 * npts",
        },
    )
)
def trace_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("doc_id"), F.floor(F.octet_length("text") / 4)
    start, rate = k * 1_000_000, (10 + k % 40).cast("double")
    end = start + F.round((size - 1) * F.lit(1e6) / rate + (k % 5) * 40000).cast("long")
    rows = table(spark, sf_dir, "documents").where("text is not null").select(
        k.alias("id"), start.alias("start_us"), (size + F.when(k % 6 == 0, 1).otherwise(0)).alias("npts"), rate.alias("rate_hz"), F.col("text").cast("binary").alias("data"),
        F.when(k % 8 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("data_sha256"), F.when(k % 3 == 0, "float32le").otherwise("steim2").alias("encoding"), end.alias("end_us"),
    )
    return _count(rows, rules.trace())


DETECTION = """
select event_id as id, epoch_us(ts) as window_start, epoch_us(ts) + (event_id % 10 - 1) * 1000000 as window_end, epoch_us(ts) + (event_id % 7) * 1000000 as detected_at, case when event_id % 3 = 0 then value / 500 end as probability,
  case when event_id % 6 = 0 then 'platt' when event_id % 9 = 0 then '' end as calibration, event_id % 5 = 0 as is_stub, event_id % 4 = 0 as located, [value / 480, 0.5] as p from events"""


@query(
    _counted(
        DETECTION,
        {
            "window ends before it starts": "window_end < window_start",
            "detected outside the window": "not (detected_at between window_start and window_end)",
            "probability without calibration": "probability is not null and coalesce(calibration, '') = ''",
            "stub with a location": "is_stub and located",
            "class probability outside 0 to 1": "len(list_filter(p, lambda x: x < 0 or x > 1)) > 0",
        },
    )
)
def detection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at, v = F.col("event_id"), micros("ts"), F.col("value")
    rows = table(spark, sf_dir, "events").select(
        k.alias("id"), at.alias("window_start"), (at + (k % 10 - 1) * 1_000_000).alias("window_end"), (at + (k % 7) * 1_000_000).alias("detected_at"), F.when(k % 3 == 0, v / 500).alias("probability"),
        F.when(k % 6 == 0, "platt").when(k % 9 == 0, "").alias("calibration"), (k % 5 == 0).alias("is_stub"), (k % 4 == 0).alias("located"), F.create_map(F.lit("slide"), v / 480, F.lit("quake"), F.lit(0.5)).alias("class_probabilities"),
    )
    return _count(rows, rules.detection())


@query(
    _counted(
        "select p_partkey as id, ['watch', 'insufficient_data', 'quiet'][p_partkey % 3 + 1] as tier, case when p_partkey % 4 > 0 then p_retailprice end as score, case when p_partkey % 5 = 0 then 'no data' end as reason from part",
        {
            "insufficient with a score": "tier = 'insufficient_data' and score is not null",
            "tier without a score": "tier <> 'insufficient_data' and score is null",
            "insufficient without a reason": "tier = 'insufficient_data' and reason is null",
            "tier with a reason": "tier <> 'insufficient_data' and reason is not null",
        },
    )
)
def watch_state_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tier = F.when(k % 3 == 0, "watch").when(k % 3 == 1, "insufficient_data").otherwise("quiet")
    return _count(table(spark, sf_dir, "part").select(k.alias("id"), tier.alias("tier"), F.when(k % 4 > 0, F.col("p_retailprice")).alias("score"), F.when(k % 5 == 0, "no data").alias("reason")), rules.watch_state())


@query(
    _counted(
        "select l_orderkey as id, l_linenumber > 2 as determined, case when l_partkey % 3 = 0 then 'no_arrival' end as blocked_by, case when l_partkey % 4 > 0 then l_extendedprice end as expected_loss, case when l_partkey % 7 = 0 then l_tax end as avoided from lineitem",
        {
            "determined and blocked": "determined and blocked_by is not null",
            "determined without a loss": "determined and expected_loss is null",
            "undetermined without a reason": "not determined and blocked_by is null",
            "undetermined with a loss": "not determined and (expected_loss is not null or avoided is not null)",
        },
    )
)
def asset_loss_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") > 2).alias("determined"), F.when(k % 3 == 0, "no_arrival").alias("blocked_by"), F.when(k % 4 > 0, F.col("l_extendedprice")).alias("expected_loss"), F.when(k % 7 == 0, F.col("l_tax")).alias("avoided"))
    return _count(rows, rules.asset_loss())


@query(
    _counted(
        "select o_orderkey as id, epoch_us(o_orderdate) as started_at, epoch_us(o_orderdate) + (o_orderkey % 12 - 1) * 1000 as finished_at, o_orderkey % 4 = 0 as wall_clock_valid, (1 + o_orderkey % 3)::double as speed, o_orderkey % 5 = 0 as contains_synthetic, case when o_orderkey % 10 in (0, 3) then 'synthetic' else 'real' end as f, case when o_orderkey % 6 = 0 then 'failed' else 'ok' end as status, case when o_orderkey % 18 = 0 then 'no data' when o_orderkey % 24 = 0 then '' end as error from orders",
        {
            "finished before it started": "finished_at < started_at",
            "wall clock at another speed": "wall_clock_valid and speed <> 1",
            "synthetic flag differs": "contains_synthetic <> (f = 'synthetic')",
            "failed without an error": "status = 'failed' and coalesce(error, '') = ''",
        },
    )
)
def replay_report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), micros("o_orderdate")
    fixtures = F.array(F.struct(F.lit("real").alias("provenance")), F.struct(F.when((k % 10).isin(0, 3), "synthetic").otherwise("real").alias("provenance")))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), at.alias("started_at"), (at + (k % 12 - 1) * 1000).alias("finished_at"), (k % 4 == 0).alias("wall_clock_valid"), (1 + k % 3).cast("double").alias("speed"), (k % 5 == 0).alias("contains_synthetic"), fixtures.alias("fixtures"),
        F.when(k % 6 == 0, "failed").otherwise("ok").alias("status"), F.when(k % 18 == 0, "no data").when(k % 24 == 0, "").alias("error"),
    )
    return _count(rows, rules.replay_report())


@query(
    """
with r as (select s_suppkey as id, [{'lon': a, 'lat': b}, {'lon': a + 1, 'lat': b}, {'lon': a + 1, 'lat': b + 1}] || case when s_suppkey % 3 > 0 then [{'lon': a, 'lat': b}] else [] end as ring from (select s_suppkey, ((s_suppkey % 40) * 9 - 178)::double as a, ((s_suppkey % 37) * 5 - 90)::double as b from supplier)),
g as (select s_suppkey as id, r, x0, y0, w, h, x0 + w * r + case when s_suppkey % 7 = 0 then 1 else 0 end as x1, y0 + h * r + case when s_suppkey % 9 = 0 then 1 else 0 end as y1
  from (select s_suppkey, 30.0::double as r, (s_suppkey % 50) * 30.0::double + case when s_suppkey % 4 = 0 then 7 else 0 end as x0, (s_suppkey % 60) * 30.0::double + case when s_suppkey % 5 = 0 then 0.5 else 0 end as y0, s_suppkey % 20 as w, s_suppkey % 30 as h from supplier)),
f as (select unnest([case when len(ring) < 4 then 'fewer than four positions' end, case when ring[1] is distinct from ring[-1] then 'not closed' end, case when len(list_filter(ring, lambda p: abs(p.lon) > 180 or abs(p.lat) > 90)) > 0 then 'position out of range' end]) as rule from r
  union all select unnest([case when abs(x0 - round(x0 / r) * r) > 1e-6 * r then 'x_min off the lattice' end, case when abs(y0 - round(y0 / r) * r) > 1e-6 * r then 'y_min off the lattice' end, case when abs(x0 + w * r - x1) > 1e-6 * r then 'x_max doesn''t follow' end, case when abs(y0 + h * r - y1) > 1e-6 * r then 'y_max doesn''t follow' end]) from g)
select rule, count(*) as n from f where rule is not null group by rule"""
)
def geometry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings and grids."""
    k = F.col("s_suppkey")
    lon, lat = ((k % 40) * 9 - 178).cast("double"), ((k % 37) * 5 - 90).cast("double")
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.concat(F.array(at(lon, lat), at(lon + 1, lat), at(lon + 1, lat + 1)), F.when(k % 3 > 0, F.array(at(lon, lat))).otherwise(F.filter(F.array(at(lon, lat)), lambda _: F.lit(False))))
    x, y, r = (k % 50) * F.lit(30.0) + F.when(k % 4 == 0, 7.0).otherwise(0.0), (k % 60) * F.lit(30.0) + F.when(k % 5 == 0, 0.5).otherwise(0.0), F.lit(30.0)
    source = table(spark, sf_dir, "supplier")
    grids = source.select(k.alias("id"), r.alias("resolution_m"), x.alias("x_min"), y.alias("y_min"), (k % 20).alias("width"), (k % 30).alias("height"), (x + (k % 20) * r + F.when(k % 7 == 0, 1.0).otherwise(0.0)).alias("x_max"), (y + (k % 30) * r + F.when(k % 9 == 0, 1.0).otherwise(0.0)).alias("y_max"))
    return _count(source.select(k.alias("id"), ring.alias("ring")), rules.ring()).unionAll(_count(grids, rules.grid_spec()))


@query(
    """
with a as (select conv_id as id, case when conv_id % 6 > 0 then list(turn + case when conv_id % 5 = 0 and turn > 1 then -1 else 0 end order by turn, role, text) end as steps, case when conv_id % 4 = 0 then 'CET' when conv_id % 4 = 1 then 'UTC' end as zone from conversations group by conv_id),
f as (select unnest([case when steps is null then 'no time axis' end, case when len(list_filter(range(2, len(steps) + 1), lambda i: steps[i] <= steps[i - 1])) > 0 then 'not strictly increasing' end, case when coalesce(zone, 'UTC') <> 'UTC' then 'not in UTC' end]) as rule from a)
select rule, count(*) as n from f where rule is not null group by rule"""
)
def time_axis_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of each layer in file order."""
    k = F.col("conv_id")
    turn = F.col("turn") + F.when((k % 5 == 0) & (F.col("turn") > 1), -1).otherwise(0)
    axes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", turn.alias("step")))).alias("x"))
    return _count(axes.select(k.alias("id"), F.when(k % 6 > 0, F.col("x.step")).alias("steps"), F.when(k % 4 == 0, "CET").when(k % 4 == 1, "UTC").alias("zone")), rules.time_axis())


# Event records

KINDS = ("news", "peer_reviewed", "blog", "usgs_comcat", "agency_official", "dataset")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as event records with nested sources, ranges, flags and notes, each of them wrong in places."""
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 6 + 1).cast("int"))
    none = F.array().cast("array<string>")
    claims = F.concat(F.array(F.lit("volume")), F.when(k % 4 > 0, F.array(F.lit("runout"))).otherwise(none), F.when(k % 23 == 0, F.array(F.lit("weather"))).otherwise(none))
    source = lambda i, kind, claims: F.struct(i.alias("id"), kind.alias("kind"), claims.alias("claims"), F.sha2(F.concat(i, (k % 50).cast("string")), 256).alias("sha256"))
    sources = F.array(source(F.lit("a"), kind, claims), source(F.when(k % 9 == 0, "a").otherwise("b"), F.lit("news"), none))
    refs = F.when(k % 10 == 0, F.array(F.lit("z"))).when(k % 14 == 0, none).otherwise(F.array(F.lit("a")))
    known = lambda low, best: F.struct(low.cast("double").alias("low"), (low + 9).cast("double").alias("high"), best.cast("double").alias("best"), refs.alias("refs"))
    ranges = F.create_map(F.lit("volume"), known(F.col("n_chars"), F.when(k % 3 == 0, F.col("n_chars") + 1)), F.lit("runout"), F.when(k % 5 > 0, known(k, F.lit(None))))
    flags = F.create_map(F.lit("dammed_river"), F.when(k % 4 > 0, k % 2 == 0), F.lit("secondary_surge"), F.lit(True))
    noted = F.array(F.when(k % 5 == 0, F.lit("runout")), F.when(k % 8 == 0, F.lit("dammed_river")), F.when(k % 21 == 0, F.lit("volume")), F.when(k % 7 == 0, F.lit("seismic")))
    notes = F.map_from_arrays(F.array_compact(noted), F.transform(F.array_compact(noted), lambda _: F.lit("unknown")))
    quake = lambda i, refs: F.struct(i.alias("usgs_id"), (k % 11 == 0).alias("single_force"), refs.alias("refs"))
    role = F.when(k % 16 == 0, "negative_control").when(k % 16 == 1, "co_seismic_reference").when(k % 16 == 2, "evacuation_counterfactual").otherwise("reference")
    failure = F.when(k % 32 == 0, "moraine_collapse_glof").when(k % 32 == 1, "co_seismic_avalanche").otherwise("rock_avalanche")
    precursors = F.array(F.struct(F.when(k % 3 > 0, k % 30).alias("lead_days"), F.when(k % 6 > 0, "seen").alias("description")))
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), k.alias("event_id"), role.alias("role"), failure.alias("failure_type"), sources.alias("sources"), ranges.alias("ranges"), flags.alias("flags"), notes.alias("notes"), F.when(k % 7 > 0, quake(F.when(k % 33 > 0, F.lit("us1")), F.array(F.lit("a")))).alias("seismic"),
        F.array(quake(F.when(k % 12 == 0, "us1").otherwise("us2"), F.array(F.lit("b")))).alias("related"), precursors.alias("precursors"), F.when(k % 4 == 2, F.array(F.lit("evacuated"))).otherwise(F.array(F.lit("damaged"))).alias("impacts"), F.array(F.concat(F.lit("t"), (k % 8).cast("string"))).alias("transects"),
    )


EVENTS = """
select doc_id as k, ['news', 'peer_reviewed', 'blog', 'usgs_comcat', 'agency_official', 'dataset'][doc_id % 6 + 1] as kind, case when doc_id % 10 = 0 then 'z' when doc_id % 14 = 0 then '' else 'a' end as ref,
  doc_id % 5 > 0 as has_runout, case doc_id % 16 when 0 then 'negative_control' when 1 then 'co_seismic_reference' when 2 then 'evacuation_counterfactual' else 'reference' end as role,
  case doc_id % 32 when 0 then 'moraine_collapse_glof' when 1 then 'co_seismic_avalanche' else 'rock_avalanche' end as failure, doc_id % 7 > 0 as seismic from documents"""


@query(
    _counted(
        EVENTS,
        {
            "source id repeated": "k % 9 = 0",
            "reference to no source": "ref = 'z'",
            "claim of no field": "k % 23 = 0",
            "range without a claim": "has_runout and k % 4 = 0",
            "best without a source of its kind": "k % 3 = 0 and not (ref = 'a' and kind in ('peer_reviewed', 'usgs_comcat', 'agency_official', 'dataset'))",
            "null without a note": "not seismic and k % 7 > 0 or k % 4 = 0 and k % 8 > 0",
            "null item without a description": "k % 3 = 0 and k % 6 = 0",
            "note of no null field": "k % 21 = 0",
            "negative control is a moraine collapse": "(role = 'negative_control') <> (failure = 'moraine_collapse_glof')",
            "co-seismic reference is a co-seismic avalanche": "(role = 'co_seismic_reference') <> (failure = 'co_seismic_avalanche')",
            "co-seismic without its quake": "failure = 'co_seismic_avalanche' and (not seismic or k % 33 = 0)",
            "evacuation without lead time": "role = 'evacuation_counterfactual' and k % 3 = 0",
            "evacuation without an evacuation": "role = 'evacuation_counterfactual' and k % 4 <> 2",
            "single force without a source of its kind": "k % 11 = 0",
            "quake id repeated": "seismic and k % 33 > 0 and k % 12 = 0",
        },
    )
)
def event_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, notes, roles and seismic attributions of nested records."""
    return _count(event_records(spark, sf_dir), rules.event_record())


@query(
    f"""
with r as ({EVENTS}), u as (select k, unnest(['volume', 'runout']) as path, unnest([true, has_runout]) as known, unnest([k % 3 = 0, false]) as best, ref, kind from r)
select path, count(*) as n_known, count(*) filter (where best) as n_best, count(*) filter (where best and not (ref = 'a' and kind in ('peer_reviewed', 'usgs_comcat', 'agency_official', 'dataset'))) as n_best_unsupported from u where known group by path"""
)
def record_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every interval of nested records by path, and best values that no source supports."""
    rows = event_records(spark, sf_dir).select(F.explode(rules.known_ranges()).alias("r"), rules.best_without_source().alias("bare"))
    return rows.groupBy(F.col("r.key").alias("path")).agg(F.count("*").alias("n_known"), F.count("r.value.best").alias("n_best"), F.count_if(F.array_contains("bare", F.col("r.key"))).alias("n_best_unsupported"))


@query(
    f"""
with r as ({EVENTS}), s as (select distinct k, sha256(i || (k % 50)) as h from (select k, unnest(['a', case when k % 9 = 0 then 'a' else 'b' end]) as i from r)),
l as (select unnest([sha256('a' || x), sha256('b' || x)]) as h, x from (select unnest(range(50)) as x) where x % 13 > 0),
f as (select k::varchar as event_id, 'range without a reference' as "check" from r where ref = '' union all select distinct k::varchar, 'source not in the ledger' from s where h not in (select h from l)
  union all select k::varchar, 'unknown transect' from r where k % 8 >= (select count(*) from region)
  union all select role, 'role held too seldom' from (values ('negative_control', 1), ('co_seismic_reference', 1), ('reference', 1000000000)) v(role, least) where (select count(*) from r where r.role = v.role) < least)
select "check", count(*) as n, min(event_id) as first from f group by "check\""""
)
def library_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, ledger, transects and roles of the whole library."""
    numbers = spark.range(50).where("id % 13 > 0").select(F.explode(F.array(*[F.sha2(F.concat(F.lit(x), F.col("id").cast("string")), 256) for x in "ab"])).alias("sha256"))
    transects = table(spark, sf_dir, "region").select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("transect"))
    events = event_records(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("string"))
    found = rules.library(events, numbers, transects, {"negative_control": 1, "co_seismic_reference": 1, "reference": 1_000_000_000})
    return found.groupBy("check").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(
    """
with c as (select n_regionkey as r, n_nationkey as k, n_name as section, (n_nationkey * 3)::varchar as now, case when n_nationkey % 4 > 0 or n_regionkey % 2 = 0 then n_nationkey * 3 else n_nationkey * 3 + 1 end::varchar as old from nation)
select r as scheme, count(*) filter (where now <> old) = 0 as sealed, string_agg(section, ',' order by section) filter (where now <> old) as changed from c group by r"""
)
def config_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each scheme's configuration is the one it was sealed with, else the sections that changed."""
    k = F.col("n_nationkey")
    now, then = (k * 3).cast("string"), (k * 3 + F.when((k % 4 > 0) | (F.col("n_regionkey") % 2 == 0), 0).otherwise(1)).cast("string")
    pairs = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", value))))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("scheme")).agg(pairs(now.alias("value")).alias("now"), pairs(then.alias("value")).alias("then"))
    same, changed = rules.sealed(F.col("now"), F.col("then"))
    return rows.select("scheme", same.alias("sealed"), F.nullif(F.array_join(changed, ","), F.lit("")).alias("changed"))


@query(
    """
with m as (select p_partkey as id, p_retailprice - p_size as a, case when p_partkey % 3 = 0 then p_retailprice end as best, p_retailprice - p_size + case when p_partkey % 5 > 0 then 2 * p_size else 0 end as b, p_retailprice * 0.99::double - 10 as p05, p_retailprice + p_partkey % 40 - 20 as p50, p_retailprice * 1.01::double + p_partkey % 7 as p95 from part),
c as (select *, coalesce(best, case when a > 0 and b > 0 then sqrt(a * b) else (a + b) / 2 end) as centre, b > a as wide from m)
select id, round(centre, 6) as centre, wide as has_width, p50 between a and b as median_inside, centre between p05 and p95 as centre_inside, (p50 between a and b or not wide) and centre between p05 and p95 as ok from c"""
)
def interval_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published intervals against modelled ones, within what both state."""
    k, price, size = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")
    low = price - size
    found = contracts.agreement((low, F.when(k % 3 == 0, price), low + F.when(k % 5 > 0, 2 * size).otherwise(0)), price * 0.99 - 10, price + k % 40 - 20, price * 1.01 + k % 7)
    rows = table(spark, sf_dir, "part").select(k.alias("id"), found.alias("a"))
    return rows.select("id", rounded("a.centre").alias("centre"), "a.has_width", "a.median_inside", "a.centre_inside", "a.ok")
