"""Windows of stations, the window detector as stream and twin, replay and the alert folder."""

import functools
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.operators import waveforms
from moraine.operators.waveforms import Cut
from moraine.streaming import replay, windows

SMALL = Cut(rate=4.0, seconds=60.0, band=(0.02, 1.8))


def wave(hz, start, n, rate=4.0):
    return np.sin(2 * np.pi * hz * (start + np.arange(n) / rate))


# Windows of a station


def test_resampling_keeps_tones_and_cuts_what_would_alias():
    t = np.arange(1200) / 20
    low, high = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 3.1 * t)
    out = waveforms.resampled(low + high, 20.0, 4.0)
    assert len(out) == 240 and np.abs(out - np.sin(2 * np.pi * 0.5 * np.arange(240) / 4)).max() < 0.05
    up = waveforms.resampled(low, 20.0, 40.0)
    assert len(up) == 2400 and np.abs(up[::2] - low).max() < 0.05


def test_merging_of_overlaps_gaps_and_contained_pieces():
    a, b = np.arange(8.0), 100 + np.arange(8.0)
    start, x = waveforms.merged([(1.0, b), (0.0, a)], 4.0)
    assert start == 0.0 and x.tolist() == [0, 1, 2, 3, *b.tolist()]  # the later one replaces
    assert waveforms.merged([(0.0, a), (0.5, b[:3])], 4.0)[1].tolist() == a.tolist()  # lies within
    x = waveforms.merged([(3.0, b), (0.0, a)], 4.0)[1]
    assert np.isnan(x[8:12]).all() and x[12:].tolist() == b.tolist() and len(x) == 20


def test_station_windows_equal_direct_computation(spark):
    rng = np.random.default_rng(0)
    z, n, e = rng.normal(size=(3, 1200))
    rows = [
        ("a", "X.A..HHZ", 20.0, 0.0, z[:700].tolist()), ("a", "X.A..HHZ", 20.0, 30.0, z[600:].tolist()),  # overlap
        ("a", "X.A..HH1", 20.0, -5.0, n.tolist()),  # begins before the window
        ("a", "X.A..HHE", 20.0, 0.0, e[:900].tolist()),  # too short
        ("b", "X.B..HHZ", 4.0, 0.0, [*wave(0.3, 0, 200).tolist(), *[None] * 10, *wave(0.3, 52.5, 30).tolist()]),
        ("b", "X.B..HHN", 4.0, 0.0, [*wave(0.3, 0, 100).tolist(), *[float("nan")] * 80, *wave(0.3, 45, 60).tolist()]),  # too many gaps
        ("b", "X.B..HHE", 4.0, 0.0, [5.0] * 240),  # silent without its mean
        ("c", "X.C..HHZ", 4.0, 0.0, wave(0.3, 0, 240).tolist()), ("c", "X.C..BHZ", 4.0, 0.0, wave(0.3, 0, 240).tolist()), ("c", "X.C..HHX", 4.0, 0.0, [1.0]), ("c", None, 4.0, 0.0, [1.0]), ("c", "X.C..HHN", 4.0, 0.0, None), ("c", "X.C..HHE", 4.0, 0.0, []),
    ]
    df = spark.createDataFrame(rows, "k string, channel string, rate double, offset_s double, samples array<double>")
    got = {r.k: r for r in waveforms.station_windows(df.repartition(5), ["k"], SMALL).collect()}
    assert {k: list(r.valid) for k, r in got.items()} == {"a": [True, True, False], "b": [True, False, False], "c": [False] * 3}
    assert got["a"].dropped == [None, None, "too short"] and got["b"].dropped == [None, "too many gaps", "no energy or not finite"]
    assert got["c"].dropped == ["more than one channel or rate", "no data", "no data"]
    a = np.array(got["a"].samples).reshape(3, 240)
    whole = waveforms.resampled(waveforms.conditioned(z, 20.0, SMALL), 20.0, 4.0)
    assert a[0] == pytest.approx(whole, abs=1e-6) and not a[2].any()
    early = waveforms.resampled(waveforms.conditioned(n, 20.0, SMALL), 20.0, 4.0)
    assert a[1, :220] == pytest.approx(early[20:], abs=1e-6) and not a[1, 220:].any()


# The window detector

CONFIG = windows.WindowConfig(cut=SMALL, needed_s=40.0, stride_s=5.0, cooldown_s=50.0, threshold=0.6)


share = functools.partial(windows.low_share, rate=4.0, low=(0.02, 0.3), high=(0.5, 1.8))


BASE = 1_600_000_000_000_000


def recording(stations=4, seconds=300, length=5.0, group="g"):
    """Slow swinging from 100 s to 200 s, fast at other times; the last station has a gap and another one lacks N."""
    out = []
    for s in range(stations):
        for c in "ZNEX":
            if s == 2 and c == "N":
                continue
            for k in range(int(seconds / length)):
                start = k * length
                if s == 3 and 120 <= start < 130:
                    continue
                x = wave(0.1 if 100 <= start < 200 else 1.0, start, int(length * 4)) * (1 + s)
                out.append((group, BASE + int(start * 1e6), f"NW.S{s}.00.HH{c}", k, 4.0, x.tolist()))
    return out


def test_detector_rules():
    d = windows.WindowDetector(CONFIG, share)
    chunks = sorted((s, c, q, r, np.array(x)) for _, s, c, q, r, x in recording())
    rows = d.take(chunks)
    times = [(r[1] - BASE) / 1e6 for r in rows]
    fired = [(r[1] - BASE) / 1e6 for r in rows if r[-1]]
    # Full stations are enough once three of them hold 40 s; then a window every 5 s, and none for 50 s after a detection.
    assert times[0] == pytest.approx(39.75) and len(rows[0][3].split(",")) >= 3
    assert fired and 100 < fired[0] < 160 and all(b - a >= 50 for a, b in zip(fired, fired[1:]))
    assert all(b - a >= (50 if a in fired else 5) for a, b in zip(times, times[1:]))
    assert not any(a < t < a + 50 for a in fired for t in times)
    assert all(len(b.samples) <= 360 for b in d.buffers.values()) and not any(k.endswith("X") for k in d.buffers)
    two = windows.WindowDetector(CONFIG, share)
    assert not two.take([c for c in chunks if "S0" in c[1] or "S1" in c[1]])
    every = windows.WindowDetector(windows.WindowConfig(cut=SMALL, needed_s=40.0, threshold=2.0), share).take(chunks)
    assert len(every) > 5 * len(rows)  # without a stride after each chunk
    late = windows.WindowDetector(CONFIG, share)
    late.ingest((0.0, "N.S..HHZ", 0, 4.0, np.zeros(40)))
    late.ingest((12.5e6, "N.S..HHZ", 1, 4.0, np.ones(4)))  # 2.5 s after its place
    assert late.buffers["N.S..HHZ"].samples.tolist() == [1.0] * 4


def test_stream_with_late_chunks_and_a_restart_equals_the_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = recording() + recording(3, 200, group="h")
    schema = "group string, start_us long, channel string, sequence long, rate double, samples array<double>"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, windows.detections_batch(df, CONFIG, share).collect()))
    assert {r[0] for r in want} == {"g", "h"} and any(r[-1] for r in want)
    # Files by time, but some chunks come with the next file; the last file only moves the watermark.
    late = {k for k in range(len(rows)) if k % 7 == 0}
    parts = [[] for _ in range(7)]
    for k, r in enumerate(rows):
        parts[min(5, (r[1] - BASE) // 50_000_000 + (k in late))].append(r)
    parts[6] = [("end", BASE + 10**9, "N.S..HHX", 0, 4.0, [0.0])]

    def feed(which):
        for k in which:
            spark.createDataFrame(parts[k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.1)  # files are taken by their time

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = windows.detections_stream(stream, "60 seconds", CONFIG, share)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)

    feed(range(3))
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    feed(range(3, 7))
    run()  # from the checkpoint, with state
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert 0 < first < len(got) and [(*r[:5], round(r[5], 9), r[6]) for r in got] == [(*r[:5], round(r[5], 9), r[6]) for r in want]


# Replay and alerts


def test_replay_is_ordered_and_resumes_and_alerts_are_written_once(spark, tmp_path):
    replay.register(spark)
    rows = recording(2, 100)
    df = spark.createDataFrame(rows, "group string, start_us long, channel string, sequence long, rate double, samples array<double>")
    replay.write_recording(df.repartition(5), str(tmp_path / "rec"), per_file=17)
    began = time.time()
    fail = tmp_path / "fail"
    fail.touch()

    def start():
        stream = spark.readStream.format("replay").option("path", str(tmp_path / "rec")).option("speed", 20).option("began", began).option("chunksPerPartition", 9).load()

        def check(batches):
            for b in batches:
                if os.path.exists(fail) and (b["place"] > 60).any():
                    raise ValueError("lost")
                yield b

        alerts = stream.mapInPandas(check, replay.CHUNK).select(F.concat(F.lit("al/"), F.col("place").cast("string")).alias("identifier"), F.concat(F.lit("<a>"), "channel", F.lit("</a>")).alias("xml"), "place", "start_us", "channel", "sequence")
        alerts = alerts.withColumn("xml", F.when(F.col("place") % 10 != 3, F.col("xml")))
        return alerts.writeStream.format("alert_folder").option("path", str(tmp_path / "alerts")).option("checkpointLocation", str(tmp_path / "c")).start()

    query = start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(60)
    index = tmp_path / "alerts" / "index.jsonl"
    before = len(index.read_text().splitlines()) if index.exists() else 0
    fail.unlink()
    query = start()
    end = time.time() + 90
    while time.time() < end and (not index.exists() or len(index.read_text().splitlines()) < 0.9 * len(rows)):
        time.sleep(0.5)
    query.stop()
    held = [json.loads(x) for x in index.read_text().splitlines()]
    want = sorted((r[1], r[2], r[3]) for r in rows)
    assert [(x["start_us"], x["channel"], x["sequence"]) for x in sorted(held, key=lambda x: x["place"])] == [w for k, w in enumerate(want) if k % 10 != 3]
    files = {f for f in os.listdir(tmp_path / "alerts") if f.endswith(".xml")}
    assert files == {x["path"] for x in held} == {f"al_{k}.cap.xml" for k in range(len(rows)) if k % 10 != 3} and before < len(held)


def test_a_commit_that_is_run_again_leaves_one_entry(tmp_path):
    class Row:
        def __init__(self, **k):
            self.__dict__ |= k

        def asDict(self):
            return dict(self.__dict__)

    writer = replay._Writer({"path": str(tmp_path)})
    one = writer.write([Row(identifier="a", xml="<a/>", n=1), Row(identifier="b", xml=None, n=2)])
    writer.commit([one, None], 0)
    for _ in range(3):  # killed after the commit, before the query knew of it
        two = writer.write([Row(identifier="b c", xml="<b/>", n=3)])
        writer.commit([two], 1)
    lost = writer.write([Row(identifier="d", xml="<d/>", n=4)])
    writer.abort([lost, None], 2)
    with pytest.raises(ValueError):
        replay.file_name("./_")
    assert [json.loads(x)["identifier"] for x in (tmp_path / "index.jsonl").read_text().splitlines()] == ["a", "b c"]
    assert {f for f in os.listdir(tmp_path) if f.endswith(".xml")} == {"a.cap.xml", "b_c.cap.xml"} and not os.listdir(tmp_path / "_staged")
