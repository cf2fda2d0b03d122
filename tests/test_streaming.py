"""The stream gives what its batch twin gives, and both what the rules say."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.streaming import detector

CONFIG = detector.DetectorConfig(high=(0.5, 2.0), ratio=5.0)


def test_stream_equals_batch(spark, tmp_path):
    from moraine.plans.records import _chunks

    chunks = _chunks(spark, "/root/testdata/sf0.01")
    for part in range(3):
        chunks.where(F.floor(F.col("start_us") / 300_000_000) % 3 == part if part < 0 else (F.col("start_us") >= part * 400_000_000) & (F.col("start_us") < (part + 1) * 400_000_000 if part < 2 else F.lit(True))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = detector.ratios_stream(stream, CONFIG)
    found.writeStream.foreachBatch(detector.alert_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.schema(detector.RATIOS).json(str(tmp_path / "out"))
    want = detector.ratios_batch(chunks, CONFIG)
    rows = lambda df: sorted((r.channel, r.end_us, r.n_samples, round(r.ratio, 6), r.fired) for r in df.collect())
    assert rows(got) == rows(want) and any(r[-1] for r in rows(want)) and not all(r[-1] for r in rows(want))
    assert detector.golden_differences(want, want).count() == 0
    off = want.withColumn("ratio", F.col("ratio") * (1 + F.when(F.col("channel") == "3", 1e-5).otherwise(1e-8)))
    assert {r.problem for r in detector.golden_differences(want, off, most=10**6).collect()} == {"ratio"}


def tone(hz, seconds, rate=20.0, start=0.0):
    t = start + np.arange(int(seconds * rate)) / rate
    return np.sin(2 * math.pi * hz * t)


def chunks_of(x, rate=20.0, seconds=5.0, start=0.0):
    n = int(seconds * rate)
    return [((start + k * seconds) * 1e6, rate, x[k * n : (k + 1) * n]) for k in range(len(x) // n)]


def test_tones_have_ratios_of_their_bands():
    c = detector.DetectorConfig(fill_s=60)
    for hz, low, high in ((0.05, 100, math.inf), (3.0, 0, 0.01)):
        rows = detector.advance(None, chunks_of(tone(hz, 120)), c)[1]
        assert len(rows) == 13 and low <= rows[-1][6] <= high


def test_fill_counts_and_buffer_is_bounded():
    rows = detector.advance(None, chunks_of(np.random.default_rng(0).normal(size=20 * 50)), detector.DetectorConfig(fill_s=30))[1]
    assert len(rows) == 5 and [r[2] for r in rows] == [600, 700, 800, 900, 1000]  # ten chunks of 5 s, none below 30 s
    state, rows = detector.advance(None, chunks_of(tone(1.0, 300)), detector.DetectorConfig())
    assert len(state[2]) == 2400 and rows[-1][0] == 180_000_000 and rows[-1][1] == round(300e6 - 50_000)


def test_cooldown_gaps_and_rates():
    c = detector.DetectorConfig(fill_s=60, cooldown_s=100)
    fired = [r[1] for r in detector.advance(None, chunks_of(tone(0.05, 400)), c)[1] if r[-1]]
    assert len(fired) > 2 and all(b - a >= 100e6 for a, b in zip(fired, fired[1:]))
    calm = chunks_of(tone(0.05, 60))
    late = chunks_of(tone(0.05, 60), start=60.2)  # four samples late: a new buffer, and no cooldown
    assert [r[-1] for r in detector.advance(None, calm + late, c)[1]] == [True, True]
    near = chunks_of(tone(0.05, 60), start=60.05)  # one sample late is in tolerance
    assert [r[-1] for r in detector.advance(None, calm + near, c)[1]].count(True) == 1
    other = [(60e6 + k * 5e6, 10.0, tone(0.05, 5, 10.0)) for k in range(3)]
    assert len(detector.advance(None, calm + other, c)[0][2]) == 150  # another rate starts anew
    assert len(detector.append((0.0, 20.0, np.zeros(100), None), 6.5e6, 20.0, np.zeros(100), detector.WINDOWED)[2]) == 200
    assert len(detector.append((0.0, 20.0, np.zeros(100), None), 7.5e6, 20.0, np.zeros(100), detector.WINDOWED)[2]) == 100


def test_silence_never_fires():
    assert not any(r[-1] for r in detector.advance(None, chunks_of(np.zeros(2400)), detector.DetectorConfig())[1])


def test_unknown_components_are_left_out(spark):
    df = spark.createDataFrame([("A.B..HHZ",), ("A.B..HHX",), ("A.B.00.BHN",)], "k string")
    assert [r.k for r in df.where(detector.known_components(F.col("k"))).collect()] == ["A.B..HHZ", "A.B.00.BHN"]


def test_decoding(spark):
    good = '{"schema_name": "w", "schema_version": "1.9.3", "payload": {"a": 1}}'
    raws = [good, good.replace("1.9.3", "2.0.0"), good.replace('"w"', '"v"'), "{", "[1]", '{"payload": {}}', good.replace("{\"a\": 1}", "7")]
    rows = detector.decoded(spark.createDataFrame([(r,) for r in raws], "raw string"), {"w": ("1.2.0", "a int")}).collect()
    assert [r.problem for r in rows] == [None, "major version mismatch", "unknown schema", "malformed envelope", "malformed envelope", "schema_name or schema_version missing", "payload does not satisfy its schema"]
    assert rows[0].envelope.w.a == 1


def test_alert_has_language_expiry_and_area(spark):
    from xml.etree import ElementTree

    from moraine.streaming.alerts import alert_xml

    rows = spark.createDataFrame([("id", "2021-01-01T00:00:00+00:00", "Severe", "Immediate", "2021-01-01T06:00:00+00:00", "a <valley>")], "identifier string, sent string, severity string, urgency string, expires string, area string")
    root = ElementTree.fromstring(alert_xml(rows, "s", "de").first().xml)
    texts = {e.tag.rpartition("}")[2]: e.text for e in root.iter()}
    assert (texts["language"], texts["expires"], texts["areaDesc"]) == ("de", "2021-01-01T06:00:00+00:00", "a <valley>") and "severe" in texts["headline"]
