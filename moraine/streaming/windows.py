"""A detector over windows of many stations: buffers of all channels of a group, one stride and one cooldown for all of them.

Chunks are taken in the order (start, channel, sequence), whatever order they arrive in. After each the detector asks: are enough
stations full, has the stride passed since the last window and the cooldown since the last detection? Then
the buffers become windows that end with the chunk, and a score says whether they fire. ``WindowDetector`` is the
state and its rules; the batch twin and the stream, which keeps it in Spark's state and takes
chunks when the watermark has passed them, share it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from moraine.functions.signal import band_energies
from moraine.operators.waveforms import ALIASES, Cut, laid_out

OUT = "group string, start_us long, end_us long, n_stations int, stations string, score double, fired boolean"
NAMES = [x.split()[0] for x in OUT.split(", ")]
Chunk = tuple[float, str, int, float, np.ndarray]  # start_us, channel, sequence, rate, samples
Score = Callable[[np.ndarray, np.ndarray], float]


def low_share(windows: np.ndarray, valid: np.ndarray, rate: float = 20.0, low: tuple[float, float] = (0.02, 0.1), high: tuple[float, float] = (0.5, 5.0)) -> float:
    """Energy in the low band as a share of that in both, over all valid channels."""
    a, b = np.sum([band_energies(x, rate, low, high) for x in windows[valid]], 0) if valid.any() else (0.0, 0.0)
    return float(a / (a + b)) if a + b > 0 else 0.0


@dataclass(frozen=True)
class WindowConfig:
    """needed_s: seconds in its buffer that make a channel full. stride_s: seconds between windows, 0 for one after each chunk."""

    cut: Cut = Cut()
    needed_s: float = 600.0
    stride_s: float = 0.0
    cooldown_s: float = 600.0
    stations: int = 3
    most_stations: int = 12
    gap_s: float = 2.0
    threshold: float = 0.5


#: A window as soon as 180 s are there, zeros before, and then every 30 s.
SLIDING = WindowConfig(needed_s=180.0, stride_s=30.0)


def component_of(channel: str) -> str | None:
    return next((c for c, codes in ALIASES.items() if channel[-1:].upper() in codes), None)


def station_of(channel: str) -> str:
    """Network, station, location and band of a channel's name."""
    network, station, location, code = channel.split(".")
    return f"{network}.{station}.{location}.{code[:1]}"


@dataclass
class Buffer:
    rate: float
    start_us: float
    samples: np.ndarray

    @property
    def seconds(self) -> float:
        return len(self.samples) / self.rate


@dataclass
class WindowDetector:
    config: WindowConfig
    score: Score
    buffers: dict[str, Buffer] = field(default_factory=dict)
    scored_us: float | None = None
    fired_us: float | None = None

    def ingest(self, chunk: Chunk) -> None:
        """Adds to the channel's buffer, which starts anew after a gap or with another rate; channels of no known component are left out."""
        start, channel, _, rate, x = chunk
        if channel.count(".") != 3 or component_of(channel) is None or not len(x):
            return
        held = self.buffers.get(channel)
        if held is not None and (held.rate != rate or abs(start - held.start_us - len(held.samples) * 1e6 / rate) > self.config.gap_s * 1e6):
            held = None
        if held is None:
            held = Buffer(rate, start, np.empty(0))
        samples = np.concatenate((held.samples, np.asarray(x, float)))
        over = max(0, len(samples) - int(self.config.cut.seconds * rate * 1.5))
        self.buffers[channel] = Buffer(rate, held.start_us + over * 1e6 / rate, samples[over:])

    def poll(self, now_us: float) -> tuple | None:
        """A row if a window is scored now."""
        c = self.config
        full = {station_of(k) for k, b in self.buffers.items() if b.seconds >= c.needed_s}
        waits = self.scored_us is not None and now_us - self.scored_us < c.stride_s * 1e6
        cools = self.fired_us is not None and now_us - self.fired_us < c.cooldown_s * 1e6
        if len(full) < c.stations or waits or cools:
            return None
        self.scored_us = now_us
        begin = now_us - c.cut.seconds * 1e6
        names = sorted({station_of(k) for k in self.buffers})[: c.most_stations]
        windows = np.zeros((len(names), len(ALIASES), round(c.cut.seconds * c.cut.rate)), np.float32)
        valid = np.zeros(windows.shape[:2], bool)
        for channel in sorted(self.buffers):
            if station_of(channel) not in names:
                continue
            b = self.buffers[channel]
            at = names.index(station_of(channel)), list(ALIASES).index(component_of(channel))
            x = laid_out(b.samples, (b.start_us - begin) / 1e6, b.rate, c.cut) if len(b.samples) > 1 else None
            if x is not None:
                windows[at], valid[at] = x, True
        used = valid.any(1)
        if used.sum() < c.stations:
            return None
        score = float(self.score(windows, valid))
        fires = score >= c.threshold
        if fires:
            self.fired_us = now_us
        return round(begin), round(now_us), int(used.sum()), ",".join(n for n, u in zip(names, used) if u), score, fires

    def take(self, chunks: list[Chunk]) -> list[tuple]:
        """Rows of chunks, which are in order."""
        out = []
        for chunk in chunks:
            self.ingest(chunk)
            if (row := self.poll(chunk[0] + (len(chunk[4]) - 1) * 1e6 / chunk[3])) is not None:
                out.append(row)
        return out


COLUMNS = ["group", "start_us", "channel", "sequence", "rate", "samples"]


def _columns(chunks: DataFrame) -> list:
    return [F.col("group").cast("string").alias("group"), F.col("start_us").cast("double").alias("start_us"), F.col("channel").cast("string").alias("channel"), F.col("sequence").cast("long").alias("sequence"), F.col("rate").cast("double").alias("rate"), F.col("samples").cast("array<double>").alias("samples")]


def _chunks(frame: pd.DataFrame) -> list[Chunk]:
    return list(zip(frame["start_us"], frame["channel"], frame["sequence"], frame["rate"], frame["samples"]))


def detections_batch(chunks: DataFrame, config: WindowConfig = WindowConfig(), score: Score = low_share) -> DataFrame:
    """The twin: each group's chunks are read through in order. chunks: group, start_us, channel, sequence, rate, samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, detector = None, None
        for batch in batches:
            out = []
            for key, rows in batch.groupby("group", sort=False):
                if detector is None or key != group:
                    group, detector = key, WindowDetector(config, score)
                out += [(key, *row) for row in detector.take(_chunks(rows))]
            yield pd.DataFrame(out, columns=NAMES)

    ordered = chunks.select(*_columns(chunks)).repartition("group").sortWithinPartitions("group", "start_us", "channel", "sequence")
    return ordered.mapInPandas(run, OUT)


class _Processor(StatefulProcessor):
    """Chunks wait in a list until the watermark has passed their start, which a timer tells; then they are taken in order."""

    def __init__(self, config: WindowConfig, score: Score):
        self.config, self.score = config, score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "start_us double, channel string, sequence long, rate double, samples array<double>")
        self.detector = handle.getValueState("detector", "held binary")

    def _advance(self, key: tuple, passed_ms: int) -> Iterator[pd.DataFrame]:
        rows = [(s, c, q, r, np.asarray(x, float)) for s, c, q, r, x in self.waiting.get()]
        due = sorted((r for r in rows if r[0] < passed_ms * 1000), key=lambda r: r[:3])
        if not due:
            return
        detector = WindowDetector(self.config, self.score)
        if self.detector.exists():
            detector.buffers, detector.scored_us, detector.fired_us = pickle.loads(self.detector.get()[0])
        out = detector.take(due)
        self.detector.update((pickle.dumps((detector.buffers, detector.scored_us, detector.fired_us)),))
        left = [(s, c, q, r, x.tolist()) for s, c, q, r, x in rows if s >= passed_ms * 1000]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=NAMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.waiting.appendList([(float(s), c, int(q), float(r), list(map(float, x))) for s, c, q, r, x in _chunks(frame)])
                for start in frame["start_us"].unique():
                    self.handle.registerTimer(int(start // 1000) + 1)
        yield pd.DataFrame([], columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def detections_stream(chunks: DataFrame, delay: str = "30 seconds", config: WindowConfig = WindowConfig(), score: Score = low_share) -> DataFrame:
    """The stream: chunks up to ``delay`` late, by their start, find their place; later ones are dropped.

    Needs the RocksDB state store. State of a group: its buffers, at most one and a half windows a channel, and the
    chunks that the watermark hasn't passed.
    """
    timed = chunks.select(*_columns(chunks), F.timestamp_micros(F.col("start_us").cast("long")).alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("group").transformWithStateInPandas(_Processor(config, score), OUT, "append", "eventTime")
