"""A keyed detector over ordered chunks of samples, as a stream and as its batch twin, and alerts from detections.

State of a channel: the samples of the last ``buffer_s`` seconds without a gap, their rate and start,
and the end at the last detection. A chunk that doesn't follow on, or has another rate, starts a new
state, which also forgets the cooldown. After each chunk a buffer of at least ``fill_s`` gives a ratio
of the energy in two closed bands; it fires if that is finite and above ``ratio`` (strictly) and the last
detection is at least ``cooldown_s`` ago. Stream and twin share one function.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.signal import band_energies

RATIOS = "channel string, start_us long, end_us long, n_samples long, rate double, low double, high double, ratio double, fired boolean"
STATE = "start_us double, rate double, samples array<double>, fired_us double"
COLUMNS = [x.split()[0] for x in RATIOS.split(", ")]
State = tuple[float, float, np.ndarray, float | None]


@dataclass(frozen=True)
class DetectorConfig:
    """gap_samples: how far a chunk may be off its place; gap_s: the same in seconds, instead."""

    buffer_s: float = 120.0
    fill_s: float = 60.0
    low: tuple[float, float] = (0.02, 0.1)
    high: tuple[float, float] = (1.0, 10.0)
    ratio: float = 10.0
    cooldown_s: float = 300.0
    gap_samples: float = 1.5
    gap_s: float | None = None


#: Buffers of the window detector: gaps in seconds, and half as much again as a window of 600 s.
WINDOWED = DetectorConfig(buffer_s=900.0, fill_s=600.0, gap_s=2.0)


def append(state: State | None, start_us: float, rate: float, data: np.ndarray, c: DetectorConfig) -> State:
    """The buffer with a chunk; a new one if the chunk doesn't follow on."""
    if state is not None:
        off = abs(start_us - (state[0] + len(state[2]) * 1e6 / state[1])) / 1e6
        if rate != state[1] or (off > c.gap_s if c.gap_s is not None else off * state[1] > c.gap_samples):
            state = None
    begin, _, held, fired = state or (start_us, rate, np.empty(0), None)
    held = np.concatenate((held, data))
    over = max(0, len(held) - round(c.buffer_s * rate))
    return begin + over * 1e6 / rate, rate, held[over:], fired


def advance(state: State | None, chunks: Iterable[tuple[float, float, np.ndarray]], c: DetectorConfig) -> tuple[State | None, list[tuple]]:
    """The state after chunks (start, rate, samples) in time order, and a row for each ratio."""
    out = []
    for start_us, rate, data in chunks:
        state = append(state, start_us, rate, np.asarray(data, float), c)
        begin, rate, held, fired = state
        if len(held) / rate < c.fill_s:
            continue
        end = begin + (len(held) - 1) * 1e6 / rate
        low, high = band_energies(held, rate, c.low, c.high)
        ratio = low / high if high > 0 else math.inf if low > 0 else 0.0
        fires = math.isfinite(ratio) and ratio > c.ratio and (fired is None or (end - fired) / 1e6 >= c.cooldown_s)
        out.append((round(begin), round(end), len(held), rate, low, high, ratio, fires))
        if fires:
            state = (begin, rate, held, end)
    return state, out


def known_components(channel: Column, components: str = "ZNE") -> Column:
    """Channels whose last letter is a component; others are left out of windows."""
    return F.contains(F.lit(components), F.substring(channel, -1, 1))


def _rows(frame: pd.DataFrame) -> Iterator[tuple[float, float, np.ndarray]]:
    return zip(frame["start_us"].tolist(), frame["rate"].tolist(), frame["samples"])


def ratios_batch(chunks: DataFrame, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The twin: sorted partitions are read through, one channel's buffer in memory at a time. chunks: channel, start_us, rate, samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, state = None, None
        for batch in batches:
            found = []
            for key, rows in batch.groupby("channel", sort=False):
                if key != channel:
                    channel, state = key, None
                state, out = advance(state, _rows(rows), config)
                found += [(key, *x) for x in out]
            yield pd.DataFrame(found, columns=COLUMNS)

    ordered = chunks.select(F.col("channel").cast("string").alias("channel"), "start_us", "rate", "samples").repartition("channel").sortWithinPartitions("channel", "start_us")
    return ordered.mapInPandas(run, RATIOS)


def ratios_stream(chunks: DataFrame, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The stream; a channel's chunks must arrive in time order from one micro-batch to the next."""

    def run(key, batches, held) -> Iterator[pd.DataFrame]:
        state = None
        if held.exists:
            start, rate, samples, fired = held.get
            state = (start, rate, np.asarray(samples, float), fired)
        rows = pd.concat(list(batches)).sort_values("start_us", kind="stable")
        state, out = advance(state, _rows(rows), config)
        if state is not None:
            held.update((float(state[0]), float(state[1]), state[2].tolist(), state[3]))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=COLUMNS)

    rows = chunks.select(F.col("channel").cast("string").alias("channel"), "start_us", "rate", "samples")
    return rows.groupBy("channel").applyInPandasWithState(run, RATIOS, STATE, "append", "NoTimeout")


def golden_differences(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6, most: int = 10) -> DataFrame:
    """(channel, end_us, problem) of two runs, at most so many and in order: rows of one only, counts or fires that differ, ratios beyond the relative tolerance.

    Infinite ratios must be equal.
    """
    keys = ["channel", "end_us"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(p + c) for c in ("n_samples", "ratio", "fired")])
    both = side(expected, "e_").join(side(actual, "a_"), keys, "full")
    e, a = F.col("e_ratio"), F.col("a_ratio")
    close = (F.greatest(F.abs(e), F.abs(a)) < float("inf")) & (F.abs(e - a) <= tolerance * F.greatest(F.abs(e), F.abs(a)))
    apart = (e != a) & ~F.coalesce(close, F.lit(False))
    problem = F.when(F.col("a_fired").isNull(), "missing").when(F.col("e_fired").isNull(), "not expected").when(F.col("e_n_samples") != F.col("a_n_samples"), "count").when(F.col("e_fired") != F.col("a_fired"), "fired").when(apart, "ratio")
    return both.select(*keys, problem.alias("problem")).where("problem is not null").orderBy(*keys).limit(most)


def replay_report(messages: DataFrame, origin_us: Column, speed: float) -> DataFrame:
    """(kind, n, first_us, latency_s, due_wall_s): how many messages of each kind a replay gave, the stream time of the first, how long after the origin that is, and when a replay at that speed is due to give it.

    messages: kind, stream_us. Wall time counts from the first message of all.
    """
    by = messages.groupBy("kind").agg(F.count("*").alias("n"), F.min("stream_us").alias("first_us"))
    start = F.broadcast(messages.agg(F.min("stream_us").alias("_start")))  # one row
    return by.crossJoin(start).select("kind", "n", "first_us", ((F.col("first_us") - origin_us) / 1e6).alias("latency_s"), ((F.col("first_us") - F.col("_start")) / 1e6 / speed).alias("due_wall_s"))


def decoded(messages: DataFrame, registry: dict[str, tuple[str, str]], raw: str = "raw") -> DataFrame:
    """messages with ``envelope`` and ``problem``: JSON envelopes of the registered schemas (name: version and DDL of the payload).

    A malformed envelope, a lack of header fields, an unknown schema, another major version and a payload that doesn't parse are
    problems, the first one is named. ``envelope`` has a payload field for each schema.
    """
    head = F.from_json(raw, "schema_name string, schema_version string")
    whole = F.get_json_object(raw, "$")
    name, version = head["schema_name"], head["schema_version"]
    major = F.regexp_extract(version, r"^([0-9]+)(\.|$)", 1)
    known = F.create_map(*[F.lit(x) for n, (v, _) in registry.items() for x in (n, v.partition(".")[0])])
    want = F.try_element_at(known, name)
    payload = F.get_json_object(raw, "$.payload")
    parts = {n: F.when(name == n, F.from_json(payload, ddl, {"mode": "PERMISSIVE"})) for n, (_, ddl) in registry.items()}
    fits = F.coalesce(*[F.when(name == n, F.from_json(payload, ddl).isNotNull() & payload.startswith("{")) for n, (_, ddl) in registry.items()], F.lit(False))
    problem = (
        F.when(whole.isNull() | ~F.trim(raw).startswith("{"), "malformed envelope").when(name.isNull() | version.isNull(), "schema_name or schema_version missing").when(want.isNull(), "unknown schema")
        .when(major == "", "malformed schema_version").when(major != want, "major version mismatch").when(~fits, "payload does not satisfy its schema")
    )
    return messages.withColumn("problem", problem).withColumn("envelope", F.when(F.col("problem").isNull(), F.struct(name.alias("schema_name"), version.alias("schema_version"), *[x.alias(n) for n, x in parts.items()])))


def windows_with_stations(chunks: DataFrame, length: str, slide: str, least: int) -> DataFrame:
    """Sliding windows in which at least so many channels have a chunk. chunks: channel, ts."""
    counted = chunks.groupBy(F.window("ts", length, slide)).agg(F.count_distinct("channel").alias("n_channels"), F.count("*").alias("n_chunks"))
    return counted.where(F.col("n_channels") >= least).select(F.col("window.start").alias("start"), "n_channels", "n_chunks")


def late_counts(chunks: DataFrame, length: str, delay: str) -> DataFrame:
    """Windowed counts of a stream that wait for data up to ``delay`` late. chunks: channel, ts (timestamp), value."""
    return chunks.withWatermark("ts", delay).groupBy(F.window("ts", length), "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def alert_sink(folder: str):
    """A foreachBatch function that writes each detection once: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={batch_id}")

    return write
