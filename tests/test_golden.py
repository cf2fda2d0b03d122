"""The detector against a committed run, and catalogues against the count that they declare."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.sources import readers
from moraine.streaming import detector

RUN = Path(__file__).with_name("golden") / "detector.jsonl"
CONFIG = detector.DetectorConfig(fill_s=20.0, buffer_s=40.0, high=(0.5, 2.0), ratio=5.0, cooldown_s=60.0)


def chunks(spark):
    """Two channels of 5 s chunks, slow swinging for a time, one with a gap."""
    rows = []
    for name, turn in (("A.B..HHZ", 1.0), ("A.C..HHZ", 1.7)):
        for k in range(40):
            if name == "A.C..HHZ" and k == 22:
                continue
            t = k * 5 + np.arange(40) / 8
            x = np.sin(2 * np.pi * 1.1 * t * turn) * (0.2 if 12 <= k < 28 else 1.0) + np.sin(2 * np.pi * 0.06 * t * turn) + 0.05 * np.cos(7 * t * t % 11)
            rows.append((name, k * 5_000_000, 8.0, x.tolist()))
    return spark.createDataFrame(rows, "channel string, start_us long, rate double, samples array<double>")


def test_detector_equals_the_committed_run(spark):
    got = detector.ratios_batch(chunks(spark), CONFIG)
    want = spark.createDataFrame([tuple(json.loads(x).values()) for x in RUN.read_text().splitlines()], "channel string, end_us long, n_samples long, ratio double, fired boolean")
    assert want.count() > 50 and want.where("fired").count() > 1
    assert detector.golden_differences(want, got).collect() == []


def test_differences_of_each_kind_are_found_in_order_and_ten_at_most(spark):
    want = spark.createDataFrame([("a", k, 10, 1.0 + k, k % 2 == 0) for k in range(30)], "channel string, end_us long, n_samples long, ratio double, fired boolean")
    k = F.col("end_us")
    got = want.where("end_us <> 3").unionByName(want.limit(1).withColumn("channel", F.lit("b")))
    got = got.withColumns({"n_samples": F.when(k == 5, 11).otherwise(F.col("n_samples")), "fired": F.when(k == 7, ~F.col("fired")).otherwise(F.col("fired")), "ratio": F.when(k == 9, F.col("ratio") * 1.00001).when(k == 11, F.col("ratio") * (1 + 1e-8)).when(k == 12, float("inf")).otherwise(F.col("ratio"))})
    assert [(r.channel, r.end_us, r.problem) for r in detector.golden_differences(want, got).collect()] == [("a", 3, "missing"), ("a", 5, "count"), ("a", 7, "fired"), ("a", 9, "ratio"), ("a", 12, "ratio"), ("b", 0, "not expected")]
    many = detector.golden_differences(want, got.withColumn("ratio", F.col("ratio") + 1)).collect()
    assert [r.end_us for r in many] == list(range(10))


def test_catalogue_declares_its_count(spark, tmp_path):
    schema = "Name string, Mag double"
    body = "".join(f"<Event><Name>e{k}</Name><Mag>{k}.5</Mag></Event>" for k in range(3))
    for name, text in (("good", f'<Results count="3">{body}</Results>\n'), ("plain", f"<Results>{body}</Results>"), ("short", f'<Results count="4">{body}</Results>'), ("cut", f'<Results count="3">{body}'), ("other", f"<html>{body}</html>")):
        (tmp_path / name).write_text(text)
    for name in ("good", "plain"):
        assert [(r.Name, r.Mag) for r in readers.catalogue_xml(spark, str(tmp_path / name), "Event", schema, "Results").collect()] == [("e0", 0.5), ("e1", 1.5), ("e2", 2.5)]
    for name, why in (("short", "declares 4 records and holds 3"), ("cut", "truncated"), ("other", "no <Results>")):
        with pytest.raises(ValueError, match=why):
            readers.catalogue_xml(spark, str(tmp_path / name), "Event", schema, "Results")
    assert readers.catalogue_xml(spark, str(tmp_path / "short"), "Event", schema).count() == 3
