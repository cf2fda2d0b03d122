"""Steps that must not grow faster than their input, against direct loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from moraine.operators import catalog, corridors, graph, ledger, ranges, scenes, surrogate, units


def test_coverage_counts_areas_without_pairs(spark):
    r = random.Random(3)
    pick = lambda *xs: r.choice(xs)
    records = [(k, pick(1, 2, 3, None), pick(7, 8, None), r.randrange(95, 105)) for k in range(12)]
    entries = []
    for _ in range(150):
        first = pick(None, *range(0, 210, 3))
        entries.append((pick(1, 2, 3, None), pick(7, 8, None), pick("O", "F"), pick("A", "R", "N"), first, None if first is None else first + r.randrange(0, 20)))
    got = ledger.coverage(
        spark.createDataFrame(records, "record_id long, event_id long, aoi_id long, day long"), spark.createDataFrame(entries, "event_id long, aoi_id long, column string, status string, first_day long, last_day long"),
        ["O", "F"], {"O": 0, "F": 0}, {"A": 0, "R": 1, "N": 2},
    )
    want = {}
    for key, event, area, day in records:
        for column in "OF":
            for name, meets in (("pre", lambda a, b: b >= day - 90 and a < day), ("event", lambda a, b: b >= day - 1 and a <= day + 1), ("post", lambda a, b: b > day and a <= day + 90)):
                held = [s for e, o, c, s, a, b in entries if c == column and ((event is not None and e == event) if a is None else ((event is not None and e == event) or (area is not None and o == area)) and meets(a, b))]
                want[key, column, name] = (min(held, key="ARN".index) if held else "none", len(held))
    assert {(x.record_id, x.column, x.window): (x.status, x.n) for x in got.collect()} == want
    # Ten thousand records by ten thousand entries of one area: pairs would be 10^8, which no row of the plan is.
    many = spark.range(10_000).select(F.col("id").alias("record_id"), (-F.col("id") - 1).alias("event_id"), F.lit(7).cast("long").alias("aoi_id"), F.lit(100).cast("long").alias("day"))
    dated = spark.range(10_000).select(F.col("id").alias("event_id"), F.lit(7).cast("long").alias("aoi_id"), F.lit("O").alias("column"), F.lit("A").alias("status"), F.lit(100).cast("long").alias("first_day"), F.lit(100).cast("long").alias("last_day"))
    cells = ledger.coverage(many, dated, ["O"], {"O": 0}, {"A": 0}).where("window = 'event'")
    assert cells.agg(F.sum("n")).first()[0] == 10**8


def test_flood_runs_tiles_that_sank_alone(spark, monkeypatch):
    # A strip with its outlet at one end: the rounds go with the number of tiles, which goes with the grid's size and not its length.
    r = random.Random(8)
    z = {(i, j): r.uniform(0, 50) for i in range(300) for j in range(4) if r.random() < 0.95}
    cells = spark.createDataFrame([(i, j, v, i == 0) for (i, j), v in z.items()], "r long, c long, z double, seed boolean")
    rounds, cut = [], corridors.cut
    monkeypatch.setattr(corridors, "cut", lambda df: rounds.append(1) or cut(df))
    one = {(x.r, x.c): x.filled for x in corridors.flood(cells, 0.5, 8).collect()}
    assert len(rounds) < 10
    tiles = {(x.r, x.c): x.filled for x in corridors.flood(cells, 0.5, 3, tile_cells=240).collect()}
    assert tiles == one and set(one) <= set(z)
    for (i, j), v in one.items():
        near = [one[a, b] for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) if (a, b) != (i, j) and (a, b) in one]
        assert v == (z[i, j] if i == 0 else max(z[i, j], min(near) + 0.5))


def test_track_means_do_not_depend_on_tasks(spark):
    # A mean of 0.12 in one order of adding and 0.12 and a bit in another, against a limit of 0.12.
    r = random.Random(1)
    rows = [(k, u, float(r.randrange(10)) / 40) for u in range(300) for k in range(65)]
    df = spark.createDataFrame(rows, "place long, track long, hidden double").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, place) as ts", "hidden / 3 as sensitivity")
    got = {x.track: (x.hidden, x.sensitivity) for x in catalog.track_metrics(df.repartition(7, F.rand(5)), "track", F.lit(19_723.0), F.lit(19_752.0), 8, 6.0, 0.12).collect()}
    for u in range(300):
        a = b = 0.0
        for _, track, hidden in rows[65 * u : 65 * u + 65]:
            a, b = a + hidden, b + hidden / 3
        assert got[u] == (a / 65, b / 65)


def test_zones_with_the_same_box_are_searched_once(spark):
    r = random.Random(5)
    box = lambda side: (x := r.uniform(0, 300), y := r.uniform(0, 300), x + r.uniform(0, side), y + r.uniform(0, side))
    units = [(k, *box(40)) for k in range(80)]
    own = [box(120) for _ in range(6)]
    zones = [(k, *own[k % 6]) for k in range(4000)]
    left, right = spark.createDataFrame(units, "unit long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(zones, "zone long, zx0 double, zy0 double, zx1 double, zy1 double")
    met = {}
    for k, z in enumerate(own):
        for u, *b in units:
            if b[0] <= z[2] and z[0] <= b[2] and b[1] <= z[3] and z[1] <= b[3]:
                met.setdefault(k, []).append((-max(0.0, min(b[2], z[2]) - max(b[0], z[0])) * max(0.0, min(b[3], z[3]) - max(b[1], z[1])), u))
    pairs = scenes.zone_units(left, right, 50.0)
    assert sorted((x.zone, x.unit, x.overlap) for x in pairs.collect()) == sorted((z, u, -v) for z, *_ in zones for v, u in met.get(z % 6, []))
    got = sorted((x.zone, x.place, x.unit, x.overlap, x.n) for x in scenes.failed_unit(left, right, 50.0).collect())
    assert got == sorted((z, i, u, -v, len(met[z % 6])) for z, *_ in zones for i, (v, u) in enumerate(sorted(met.get(z % 6, []))[:6], 1))


def test_pairs_of_units_and_zones_are_dealt_to_many_tasks(spark):
    r = random.Random(6)
    units = [(k, x := r.uniform(0, 300), y := r.uniform(0, 300), x + 20.0, y + 20.0) for k in range(60)]
    zones = [(k if k else None, 100.0 * (k % 2), 50.0, 100.0 * (k % 2) + 99.0, 160.0) for k in range(4200)]  # two boxes, more copies than a list holds, a null zone
    left = spark.createDataFrame(units, "unit long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    right = spark.createDataFrame(zones, "zone long, zx0 double, zy0 double, zx1 double, zy1 double").coalesce(1)
    got = scenes.zone_units(left, right, 50.0).withColumn("task", F.spark_partition_id()).collect()
    side = lambda a, b, c, d: min(b, d) - max(a, c)
    want = [(z or 0, u, w * h) for z, p, q, v, s in zones for u, a, b, c, d in units if (w := side(a, c, p, v)) >= 0 and (h := side(b, d, q, s)) >= 0]
    assert sorted((x.zone or 0, x.unit, x.overlap) for x in got) == sorted(want) and sum(x.zone is None for x in got) == sum(not z for z, *_ in want) > 0
    assert len({x.task for x in got}) > 1


def test_heading_names_no_value_twice(spark):
    rings = [[(0.0, 0.0), (1.0, 0.1), (1.1, 0.5), (0.1, 0.4), (0.0, 0.0)], [(0.0, 10.0), (1.0, 10.0), (1.0, 12.0)], [(0.0, 0.0), (1.0, 1.0)], [], None, [(3.0, 3.0)] * 5]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rings)], "k int, ring array<struct<lon double, lat double>>").select("k", scenes.heading(F.col("ring"), F.lit("Ascending")).alias("h"))
    got = {x.k: x.h for x in df.collect()}

    def direct(ring):
        if not ring:
            return None
        p = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        scale = math.cos(math.radians(sum(y for _, y in p) / len(p)))
        sized = [(math.hypot((b[0] - a[0]) * scale, b[1] - a[1]), i, (b[0] - a[0]) * scale, b[1] - a[1]) for i, (a, b) in enumerate(zip(p, [*p[1:], p[0]]))]
        sized = [x for x in sized if x[0] > 0]
        if len(p) < 3 or not sized:
            return None
        at = math.degrees(math.atan2(*min(sized)[2:])) % 360
        return at if at < 90 or at > 270 else (at + 180) % 360

    assert got == {k: v if (v := direct(ring)) is None else pytest.approx(v) for k, ring in enumerate(rings)}
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 5_000


def test_any_within_equals_filter(spark):
    r = random.Random(2)
    left = spark.createDataFrame([(k, r.randrange(-50, 500)) for k in range(120)], "a long, t long")
    right = spark.createDataFrame([(r.randrange(-50, 500),) for _ in range(15)], "u long")
    for low, high in ((-7, 12), (3, 3), (-20, -5)):
        near = {x.a for x in left.crossJoin(right).where(F.col("u") - F.col("t") >= low).where(F.col("u") - F.col("t") <= high).collect()}
        assert {x.a: x.found for x in ranges.any_within(left, right, "t", "u", low, high).collect()} == {k: k in near for k in range(120)}


def test_releases_by_running_counts(spark):
    r = random.Random(4)
    z = [(float(r.randrange(0, 900)), 100.0) for _ in range(400)] + [(5000.0, 7000.0)]
    members = [(k, r.choice([1.0, 5e6, 4e7, 9e7, 4e8]), low, low + 5) for k in range(150) for low in [float(r.choice([-200, 50, 400, 880, 2000, 30_000]))]]
    df = surrogate.releases(spark.createDataFrame(z, "z double, chainage double"), spark.createDataFrame(members, "member long, volume double, low double, high double"), 900.0)
    got = {x.member: (x.cells, x.low, x.high) for x in df.collect()}
    head = sorted((x for x, c in z if c <= 6000), reverse=True)
    for key, volume, low, high in members:
        need = volume / 300 / 900
        counts = [sum(low - 100 * k <= x <= high + 100 * k for x in head) for k in range(31)]
        k = next((k for k, n in enumerate(counts) if n >= need and n), 30)
        take = head[: max(1, math.floor(need))]
        assert got[key] == ((counts[k], low - 100 * k, high + 100 * k) if counts[30] else (len(take), take[-1], take[0]))
    # Members don't meet heights: nothing of the plan is a product of the two.
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_seasonal_fit_takes_each_span_and_unknown_values(spark):
    from moraine.operators import watch

    rows = [(1, 3.0, float("nan"), 0.5), (1, 1.0, 2.0, 0.9), (1, 9.0, 4.0, 0.8), (2, 50.0, 1.0, 0.7)]
    config = watch.WatchConfig(first_step=5, last_step=15, every=5, span_days=10.0)
    got = watch.deseasonalised(spark.createDataFrame(rows, "unit_id long, t double, v double, coh double"), config).collect()
    want = [(u, s, t, None if v != v else v, c) for u, t, v, c in rows for s in (5, 10, 15) if s - 10 < t <= s]
    key = lambda x: x[:3]
    assert sorted(((x.unit_id, x.step, x.t, None if x.v is None or x.v != x.v else x.v, x.coh) for x in got), key=key) == sorted(want, key=key)


def test_nearest_apart_forms_no_pairs(spark):
    r = random.Random(6)
    point = lambda k: (k, r.randrange(-300, 300), r.choice((10.0, 10.1, 10.2, 10.9)), r.choice((179.9, -179.9, 179.5)))
    left, right = [point(k) for k in range(60)], [point(k) for k in range(100, 300)] + [(400, None, 10.0, 179.9)]
    names = "id long, t long, lat double, lon double"

    def km(a, b):
        x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return round(2 * 6371.0088 * math.asin(math.sqrt(x)), 4)

    for least in (0, 20):
        got = {(x.left_id, x.rank): (x.right_id, x.km) for x in catalog.nearest_apart(spark.createDataFrame(left, names), spark.createDataFrame(right, names), 60.0, least, 50, 4).collect()}
        want = {}
        for a in left:
            held = sorted((km(a, b), b[0]) for b in right if b[1] is not None and least <= abs(a[1] - b[1]) <= 50 and km(a, b) <= 60)
            want |= {(a[0], n + 1): (b, d) for n, (d, b) in enumerate(held[:4])}
        assert got == want and len(want) > 200
    # Thirty thousand by thirty thousand at one place and within the times: pairs would be 9 x 10^8.
    many = spark.range(30_000).selectExpr("id", "id % 40 as t", "10.0D as lat", "20.0D as lon")
    far = catalog.nearest_apart(many, many.withColumn("t", F.col("t") + 100), 60.0, 50, 200, 5)
    assert far.agg(F.count("*"), F.max("right_id")).first() == (150_000, 4)


def test_loops_keep_no_estimate_of_all_their_joins(spark):
    # The driver holds a plan's estimate of bytes; with 30 digits it is beyond any table.
    small = lambda df: len(f"{df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()}") < 30
    path = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graph.components(path)
    assert small(found) and {x.node: x.component for x in found.collect()} == dict.fromkeys(range(61), 0)
    near = graph.shortest_paths(path.where("src < 6").withColumn("length", F.lit(1.0)), 0)
    assert small(near) and {x.node: x.distance for x in near.collect()} == {k: float(k) for k in range(7)}
    cells = spark.range(400).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), F.when(F.col("id") < 380, F.col("id")).otherwise(1000).alias("unit"))
    merged = units.dissolve(cells, 4)
    assert small(merged) and merged.count() == 400 and merged.groupBy("unit").count().where("count < 4").isEmpty()
    bed = spark.range(64).select(F.lit(0).alias("r"), F.col("id").alias("c"), F.lit(0.0).alias("z"), (F.col("id") == 0).alias("seed"))
    filled = corridors.flood(bed, 1.0, 8, tile_cells=64)
    assert small(filled) and {x.c: x.filled for x in filled.collect()} == {k: float(k) for k in range(64)}


def test_rounds_doubles_as_sql(spark):
    # 0.1301655 is below the tie as a double: its score was 0.130166 and 0.130165 in SQL.
    import duckdb

    from moraine.functions.rounding import rounded

    values = [0.1301655, 1.0000005, -0.1301655, 0.5, -2.5, 0.0, 123456789.1234565, 1e17 + 0.5, *((10 * k + 5) / 1e7 * (-1) ** k for k in range(2000))]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)] + [(-1, None)], "k long, x double")
    for digits in (1, 2, 4, 6, 9):
        got = {r.k: r.y for r in df.select("k", rounded("x", digits).alias("y")).collect()}
        con = duckdb.connect()
        con.execute("create table t as select unnest($1::double[]) as x, unnest(range(len($1))) as k", [values])
        assert got == dict(con.execute(f"select k, round(x, {digits}) from t").fetchall()) | {-1: None}


def test_pairs_of_dense_days_are_formed_late_and_pack_well(spark, tmp_path):
    # Ids of a day travel as one row for each frame beside it; pairs come out in runs, where before each was written in full.
    import os

    from moraine.plans import catalog as plans

    r = random.Random(4)
    rows = [(k * 13 + 1 + r.randrange(12), r.randrange(3) * 40 * 7 + 40 * r.randrange(2), r.choice("OF"), r.choice([9000, 9001, 9024, 9025, 9030])) for k in range(3000)] + [(13 * k, 0, "O", 9001) for k in range(50)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, day long")
    df.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(day) as o_orderdate").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    out = plans.pair_planner(spark, str(tmp_path))
    out.coalesce(1).write.parquet(f"{tmp_path}/out")
    got = {(x.path, x.direction, x.first, x.second, x.days) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    products = [(k, c % 40, s, d, c % 7) for k, c, s, d in rows if k % 13]
    want = {(p, s, k, m, e - d) for k, p, s, d, f in products for m, q, t, e, g in products if p == q and s == t and 1 <= e - d <= 24 and abs(f - g) <= 1}
    assert got == want and out.count() == len(want) > 500_000
    size = sum(os.path.getsize(f"{tmp_path}/out/{x}") for x in os.listdir(f"{tmp_path}/out") if x.endswith(".parquet"))
    assert size < len(want)  # a byte a pair
