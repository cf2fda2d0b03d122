"""Operators against brute force on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import geo, hazard, signal, text
from moraine.functions import quantiles as Q
from moraine.operators import contracts, ensemble, evaluate, graph, grids, inversion, ledger, ranges, watch
from moraine.sources import readers


def rng(seed=7):
    return random.Random(seed)


def test_range_join_equals_filter(spark):
    r = rng()
    a = spark.createDataFrame([(k, r.randrange(3), r.randrange(-50, 500)) for k in range(60)], "a long, g int, t long")
    b = spark.createDataFrame([(k, r.randrange(3), r.randrange(-50, 500)) for k in range(60)], "b long, g int, u long")
    got = ranges.within(a, b, ["g"], "t", "u", -7, 12).select("a", "b")
    want = a.join(b, "g").where("u - t between -7 and 12").select("a", "b")
    assert sorted(got.collect()) == sorted(want.collect())


def test_spatial_join_equals_filter(spark):
    r = rng()
    a = spark.createDataFrame([(k, r.uniform(-55, 55), r.uniform(-180, 180)) for k in range(80)] + [(999, 10.0, 179.99)], "a long, lat double, lon double")
    b = spark.createDataFrame([(k, r.uniform(-55, 55), r.uniform(-180, 180)) for k in range(80)] + [(999, 10.0, -179.99)], "b long, r_lat double, r_lon double")
    got = ranges.near(a, b, 1500.0).select("a", "b")
    want = a.crossJoin(b).where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 1500).select("a", "b")
    assert sorted(got.collect()) == sorted(want.collect()) and (999, 999) in {tuple(x) for x in got.collect()}


def test_nearest_ties_to_the_earlier(spark):
    a = spark.createDataFrame([(1, 100), (2, 500)], "a long, t long").withColumn("g", F.lit(1))
    b = spark.createDataFrame([(8, 105), (7, 95), (6, 95)], "b long, u long").withColumn("g", F.lit(1))
    got = {r.a: (r.b, r.gap) for r in ranges.nearest(a, b, ["g"], "a", "t", "u", "b", 50).collect()}
    assert got == {1: (6, 5), 2: (None, None)}


def test_islands(spark):
    r = rng()
    times = sorted(r.sample(range(2000), 150))
    rows = ranges.islands(spark.createDataFrame([(t,) for t in times], "t long"), "t", 15, 100).orderBy("t").collect()
    block, want = 0, []
    for k, t in enumerate(times):
        block += k == 0 or t - times[k - 1] > 15
        want.append(block)
    assert [x.block for x in rows] == want


@pytest.mark.parametrize("ties", ["first", "last"])
def test_latest(spark, ties):
    rows = spark.createDataFrame([(1, 5, 0, "a"), (1, 5, 1, "b"), (1, 4, 2, "c"), (2, 1, 3, "d")], "k int, at int, o int, v string")
    got = {r.k: r.v for r in ledger.latest(rows, ["k"], F.col("at"), "o", ties).collect()}
    assert got == {1: "a" if ties == "first" else "b", 2: "d"}


def test_auc_and_order_statistics(spark):
    r = rng()
    data = [(r.randrange(20) / 20, r.random() < 0.4) for _ in range(300)]
    pairs = [(a > b) + (a == b) / 2 for a, x in data if x for b, y in data if not y]
    df = spark.createDataFrame(data, "p double, y boolean").withColumn("g", F.lit(1))
    assert evaluate.roc_auc(df, ["g"], "p", F.col("y")).first().auc == pytest.approx(sum(pairs) / len(pairs))
    values = [r.gauss(0, 1) for _ in range(97)] + [0.5] * 30
    got = evaluate.kth_values(spark.createDataFrame([(1, v) for v in values], "g int, x double"), ["g"], "x", 0.9).first()
    assert got.x == sorted(values)[int(np.ceil(128 * 0.9)) - 1] and got.n == 127


def test_empty_class_and_empty_bins(spark):
    one = spark.createDataFrame([(1, 0.3, True)], "g int, p double, y boolean")
    assert evaluate.roc_auc(one, ["g"], "p", F.col("y")).first().auc == 0.5
    assert evaluate.roc_auc(one, ["g"], "p", F.col("y"), None).first().auc is None
    bins = {r.bin: r.n for r in evaluate.reliability(one, "p", F.col("y")).collect()}
    assert len(bins) == 10 and bins[2] == 1 and bins[3] == 0  # 3 * 0.1 is above 0.3


def test_percentiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(Q.array_linear(F.col("x"), 0.25)).collect()] == [1.5, 5.0, None]
    assert [r[0] for r in df.select(Q.index_pick(F.col("x"), 0.95)).collect()] == [3.0, 5.0, None]


def test_tiers_put_missing_first(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.0,), (2.0,), (1.9,)], "s double")
    assert [r[0] for r in df.select(hazard.tier(F.col("s"))).collect()] == ["insufficient", "insufficient", "watch", "elevated", "quiet"]


def test_walk_forward_is_causal(spark):
    r = rng()
    c = watch.WatchConfig(slope_days=7, span_days=21, min_samples=5, min_history=3, first_step=10, last_step=20, every=1)
    rows = [(u, d + 0.5, u * 0.1 * d + r.gauss(0, 1), 0.8) for u in range(6) for d in range(20)]
    units = spark.createDataFrame([(u, True, 1.0) for u in range(6)], "unit_id long, inside boolean, sens double")
    kind = "unit_id long, t double, v double, coh double"

    def score(samples):
        dealt = watch.at_steps(spark.createDataFrame(samples, kind), c)
        found = watch.score(watch.unit_states(dealt, units, c), c).where("step <= 15").orderBy("step", "unit_id").collect()
        return [tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in found]

    later = [(u, 16.0 + k, r.gauss(5000, 500), 0.8) for u in range(6) for k in range(3)]
    assert score(rows) == score(rows + later)
    assert score(rows) != score(rows + [(0, 14.9, 9000.0, 0.8)])


def test_graph(spark):
    r = rng()
    edges = [(r.randrange(40), r.randrange(40), float(r.randrange(1, 9))) for _ in range(35)]
    edges = [(a, b, w) for a, b, w in edges if a != b]
    df = spark.createDataFrame(edges, "src long, dst long, length double")
    label = {x: x for e in edges for x in e[:2]}
    for _ in label:
        for a, b, _w in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {x.node: x.component for x in graph.components(df).collect()} == label
    start = edges[0][0]
    best = {start: 0.0}
    for _ in label:
        for a, b, w in edges + [(b, a, w) for a, b, w in edges]:
            if a in best and best[a] + w < best.get(b, 1e9):
                best[b] = best[a] + w
    assert {x.node: x.distance for x in graph.shortest_paths(df, start).collect()} == best


def test_normal_equations(spark):
    g = np.random.default_rng(3)
    truth, rows, a, d = np.array([1.0, -2.0, 0.5]), [], [], []
    for _ in range(8):
        kernel = g.normal(size=20)
        design = inversion.design(kernel, 3)
        rows.append((kernel.tolist(), (design @ truth).tolist()))
        a.append(design)
        d.append(design @ truth)
    found = inversion.solve(inversion.normal_equations(spark.createDataFrame(rows, "kernel array<double>, data array<double>"), 3), 3, (0.0,))
    assert np.allclose(found[0][1], truth)


def test_signal():
    t = np.arange(1200) / 10
    assert signal.band_ratio(np.sin(2 * np.pi * 0.05 * t), 10, (0.01, 0.1), (1, 4)) > 100
    assert signal.band_ratio(np.sin(2 * np.pi * 3 * t), 10, (0.01, 0.1), (1, 4)) < 0.01
    assert signal.spectrum_summary(np.sin(2 * np.pi * 2 * t), 10)[1] == pytest.approx(2)
    assert signal.rectilinearity(t, 2 * t, -t) == pytest.approx(1)


def test_interval_rules(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 5.0, 2.0, 3.0), (3, None, 2.0, None)], "id int, low double, best double, high double")
    got = sorted((r.id, r.rule) for r in contracts.violations(df, ["id"], contracts.interval_rules("low", "best", "high")).collect())
    assert got == [(2, "best below low"), (2, "low above high")]


def test_loss_reason_order(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ensemble.block_reason(arrival=F.col("a"), flow_depth=F.col("b"))).collect()] == ["no_arrival", "no_flow_depth", None]


def test_titles(spark):
    rows = [('<meta content="A &amp; B" property="og:title"><title>x</title>',), ("<TITLE>\n two  words </TITLE>",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "h string").select(text.html_title(F.col("h"))).collect()] == ["A & B", "two words", None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"entry_id":"a","size_bytes":3}\n\n{"entry_id":"b"}\n')
    assert [r.entry_id for r in readers.ledger(spark, str(tmp_path / "l.jsonl")).orderBy("ordinal").collect()] == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"entry_id":\n')
    with pytest.raises(Exception):
        readers.ledger(spark, str(tmp_path / "bad.jsonl")).collect()
    feature = '{"id":"q1","properties":{"mag":4.5,"time":1000,"type":"Earthquake"},"geometry":{"coordinates":[80.5,28.5,10]}}'
    docs = spark.createDataFrame([(feature,), ('{"features":[' + feature + "]}",)], "value string")
    events = readers.geojson_events(docs)
    assert [(r.event_id, r.latitude, r.longitude, r.type) for r in events.collect()] == [("q1", 28.5, 80.5, "earthquake")] * 2
    low, high = F.timestamp_millis(F.lit(1000)), F.timestamp_millis(F.lit(2000))
    assert readers.matching(events, low, high, "EARTHQUAKE", 4.5, (80, 28, 81, 29)).count() == 2
    assert readers.matching(events, F.timestamp_millis(F.lit(0)), low).count() == 0
    with pytest.raises(Exception):
        readers.parallel_series(spark.createDataFrame([([1, 2], [1.0])], "t array<int>, v array<double>"), [], "t", "v").collect()
    chunks = readers.chunked(spark.createDataFrame([(1, list(range(7)))], "k int, x array<int>"), ["k"], "x", 3).orderBy("sequence").collect()
    assert [r.data for r in chunks] == [[0, 1, 2], [3, 4, 5], [6]]
    assert readers.synthetic_chunks(spark, 2, 3, 4, 1).collect() == readers.synthetic_chunks(spark, 2, 3, 4, 1).collect()
    readers.append_ledger(events.limit(1), str(tmp_path / "out"))
    readers.append_ledger(events.limit(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    index = readers.file_index(spark, str(tmp_path / "out"))
    assert readers.index_hash(index.where(F.col("path").endswith(".json"))).first().n == 2


def test_document_titles(spark):
    meta = '<meta name="{}" content="{}">'.format
    rows = [
        (meta("og:title", "first") + meta("citation_title", "second"), "text/html"),  # the first in the document
        ('<meta content="turned" property="og:title"><title>t</title>', "application/xhtml+xml; x"),
        (meta("og:title", " ") + "<title> a &eacute; &#233; &#xE9; &amp;amp;\n b </title>", "text/html"),
        ('{"message": {"title": ["x &lt; y", "z"]}}', "application/json"), ('{"title": "plain"}', "application/json"), ('{"message": {}, "title": "no"}', "application/json"), ('{"title": []}', "application/json"), ("{", "application/json"),
        ("<title>t</title>", "text/plain"), (None, "text/html"), ("<title></title>", "text/html"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, body string, kind string")
    got = [r.t for r in df.select("k", text.document_title(F.col("body"), F.col("kind")).alias("t")).orderBy("k").collect()]
    assert got == ["first", "turned", "a é é é &amp; b", "x < y", "plain", None, None, None, None, None, None]


def test_chip_shift_is_found():
    g = np.random.default_rng(0)
    x = sum(np.roll(g.normal(size=(32, 32)), k, 0) for k in range(3))
    dy, dx, _ = signal.match_chip(x, np.roll(x, (2, -3), (0, 1)), 5)
    assert abs(dy - 2) < 0.3 and abs(dx + 3) < 0.3
    assert signal.match_chip(np.ones((8, 8)), x[:8, :8], 2) == (0.0, 0.0, 0.0) and signal.match_chip(x, np.roll(x, (0, 5), (0, 1)), 5) == (0.0, 0.0, 0.0)


def test_alert_xml_is_escaped(spark):
    from xml.etree import ElementTree

    from moraine.streaming.alerts import alert_xml

    rows = spark.createDataFrame([("a<b&c", "2024-01-01T00:00:00+00:00", "Severe", "Immediate")], "identifier string, sent string, severity string, urgency string")
    root = ElementTree.fromstring(alert_xml(rows, "s").first().xml)
    assert root.tag.endswith("alert") and [e.text for e in root if e.tag.endswith("identifier")] == ["a<b&c"]
