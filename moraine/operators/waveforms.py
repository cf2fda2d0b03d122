"""Preparation of traces and scene pairs in their tasks: detrending, tapering, resampling and cutting to a window; rotation; tracking of chips."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.signal import match_chip


@dataclass(frozen=True)
class Cut:
    """Rate and seconds of the window, share of it that a trace must cover with real samples, taper at each end, and the band in Hz."""

    rate: float = 20.0
    seconds: float = 600.0
    least: float = 0.8
    taper: float = 0.05
    band: tuple[float, float] = (0.005, 5.0)


def conditioned(x: np.ndarray, rate: float, c: Cut) -> np.ndarray:
    """Without mean and trend, tapered by a cosine at both ends, and only what is in the band (at most 0.45 of the rate)."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    x = x - x.mean()
    x = x - t * ((t * x).sum() / max((t * t).sum(), 1e-12))
    n = max(1, int(c.taper * len(x)))
    ramp = 0.5 * (1 - np.cos(np.pi * np.arange(n) / n))
    x[:n] *= ramp
    x[len(x) - n :] *= ramp[::-1]
    spectrum, at = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(np.where((at >= c.band[0]) & (at <= min(c.band[1], 0.45 * rate)), spectrum, 0), n=len(x))


def window_of(x: np.ndarray, rate: float, offset_s: float, c: Cut) -> tuple[np.ndarray | None, str | None]:
    """Samples of the window at its rate, zeros where the trace doesn't reach, or why there are none. offset_s: start of the trace after that of the window.

    Gaps are NaN in the trace and count as zeros if they are few.
    """
    n = round(c.seconds * c.rate)
    covered = min(offset_s + (len(x) - 1) / rate, c.seconds) - max(offset_s, 0.0) if len(x) else 0.0
    if covered < c.least * c.seconds:
        return None, "too short"
    gap = ~np.isfinite(x)
    if gap.mean() > 1 - c.least:
        return None, "too many gaps"
    clean = conditioned(np.where(gap, 0.0, x), rate, c)
    at = np.arange(n) / c.rate
    out = np.interp(at, offset_s + np.arange(len(x)) / rate, clean, left=0.0, right=0.0).astype(np.float32)
    if not np.isfinite(out).all():
        return None, "not finite"
    return (out, None) if np.abs(out).max() > 0 else (None, "no energy")


def prepare(traces: DataFrame, key: str, c: Cut = Cut()) -> DataFrame:
    """(key, component, samples, dropped) of each trace. traces: key, channel, rate, offset_s, samples.

    The component is the channel's last letter, and only Z, N and E are known. Instrument response isn't
    removed here: samples come as velocity. What is dropped keeps its row with the reason.
    """
    kind = dict(traces.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = []
            for name, channel, rate, offset, x in zip(*(batch[col] for col in (key, "channel", "rate", "offset_s", "samples"))):
                component = (channel or " ")[-1].upper()
                if component not in "ZNE":
                    rows.append((name, component, None, "unknown component"))
                    continue
                found, why = window_of(np.empty(0) if x is None else np.array([np.nan if v is None else v for v in x], float), rate, offset, c)
                rows.append((name, component, None if found is None else found.tolist(), why))
            yield pd.DataFrame(rows, columns=[key, "component", "samples", "dropped"])

    return traces.select(key, "channel", "rate", "offset_s", "samples").mapInPandas(run, f"{key} {kind}, component string, samples array<float>, dropped string")


def rotated(azimuth_deg: Column, up: tuple[Column, Column], north: tuple[Column, Column], transverse: Column) -> dict[str, Column]:
    """Displacement at Z, N and E for a unit force up, north and east: column ``ZN`` is what Z records of a force to the north.

    up: vertical and radial record of a vertical force; north: of a radial force; transverse: of a transverse force. All arrays of equal length.
    """
    c, s = F.cos(F.radians(azimuth_deg)), F.sin(F.radians(azimuth_deg))
    times = lambda a, k: F.transform(a, lambda x: x * k)
    both = lambda a, j, b, k: F.zip_with(a, b, lambda x, y: x * j + y * k)
    z_up, r_up = up
    z_h, r_h = north
    return {
        "ZU": z_up, "ZN": times(z_h, c), "ZE": times(z_h, s),
        "NU": times(r_up, c), "NN": both(r_h, c * c, transverse, s * s), "NE": both(r_h, c * s, transverse, -c * s),
        "EU": times(r_up, s), "EN": both(r_h, c * s, transverse, -c * s), "EE": both(r_h, s * s, transverse, c * c),
    }


def track_pair(cells: DataFrame, pair: str, size: int, step: int, reach: int) -> DataFrame:
    """(pair, row, col, dy, dx, quality) of every chip of a grid over two scenes. cells: pair, r, c, a, b.

    A cell goes to each chip that holds it; chips that lack cells, or hold one that isn't finite, are left out.
    """
    kind = dict(cells.dtypes)[pair]
    first = lambda x: F.floor((x - size) / step) + 1
    starts = lambda x: F.explode(F.sequence(F.greatest(F.lit(0), first(x)), F.floor(x / step)))
    fine = lambda x: F.col(x).isNotNull() & ~F.isnan(x)
    dealt = cells.where(fine("a") & fine("b")).withColumn("_i", starts(F.col("r"))).withColumn("_j", starts(F.col("c")))
    chips = dealt.groupBy(pair, "_i", "_j").agg(F.array_sort(F.collect_list(F.struct("r", "c", "a", "b"))).alias("x")).where(F.size("x") == size * size)

    def run(batches):
        for batch in batches:
            found = [match_chip(np.reshape(a, (size, size)), np.reshape(b, (size, size)), reach) for a, b in zip(batch["a"], batch["b"])]
            out = batch[[pair, "row", "col"]].copy()
            out[["dy", "dx", "quality"]] = found
            yield out

    half = size // 2
    rows = chips.select(pair, (F.col("_i") * step + half).alias("row"), (F.col("_j") * step + half).alias("col"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    return rows.mapInPandas(run, f"{pair} {kind}, row long, col long, dy double, dx double, quality double")


# Codes of each component, the first one with data counts.
ALIASES = {"Z": ("Z",), "N": ("N", "1"), "E": ("E", "2")}


def resampled(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """The trace at another rate: its spectrum cut off, or continued with zeros, at the new half rate, so nothing is aliased."""
    n = int(len(x) * to / rate)
    if n == len(x) or not len(x):
        return x
    spectrum, out = np.fft.rfft(x), np.zeros(n // 2 + 1, complex)
    k = min(len(spectrum), len(out))
    out[:k] = spectrum[:k]
    return np.fft.irfft(out, n=n) * (n / len(x)) if n else np.empty(0)


def merged(pieces: list[tuple[float, np.ndarray]], rate: float) -> tuple[float, np.ndarray]:
    """One trace from pieces (start, samples) of a channel: a later piece replaces what it overlaps, one that lies within what is held is left out, gaps are NaN."""
    pieces = sorted((p for p in pieces if len(p[1])), key=lambda p: (p[0], -len(p[1])))
    start, held = pieces[0][0], np.asarray(pieces[0][1], float)
    for begin, x in pieces[1:]:
        at = round((begin - start) * rate)
        if at + len(x) <= len(held):
            continue
        gap = np.full(max(0, at - len(held)), np.nan)
        held = np.concatenate((held[:at], gap, np.asarray(x, float)))
    return start, held


def laid_out(x: np.ndarray, start: float, rate: float, c: Cut) -> np.ndarray | None:
    """A conditioned trace at the window's rate, cut to the window and filled with zeros; None if nothing finite and loud is left. start: after that of the window."""
    clean = resampled(conditioned(x, rate, c), rate, c.rate)
    n, at = round(c.seconds * c.rate), round(start * c.rate)
    out = np.zeros(n)
    a, b = max(0, at), min(n, at + len(clean))
    if a >= b:
        return None
    out[a:b] = clean[a - at : b - at]
    with np.errstate(over="ignore"):
        out = out.astype(np.float32)  # what overflows becomes infinite and is refused
    return out if np.isfinite(out).all() and np.abs(out).max() > 0 else None


def component_window(pieces: list[tuple[str, float, float, np.ndarray]], c: Cut) -> tuple[np.ndarray | None, str | None]:
    """Samples of one component from pieces (channel, rate, start, samples), or why there are none."""
    pieces = [p for p in pieces if len(p[3])]
    if not pieces:
        return None, "no data"
    if len({(channel, rate) for channel, rate, _, _ in pieces}) > 1:
        return None, "more than one channel or rate"
    rate = pieces[0][1]
    start, x = merged([(s, d) for _, _, s, d in pieces], rate)
    if min(start + (len(x) - 1) / rate, c.seconds) - max(start, 0.0) < c.least * c.seconds:
        return None, "too short"
    gap = np.isnan(x)
    if gap.mean() > 1 - c.least:
        return None, "too many gaps"
    if len(x) < 2:
        return None, "too short"
    out = laid_out(np.where(gap, 0.0, x), start, rate, c)
    return (out, None) if out is not None else (None, "no energy or not finite")


def station_windows(traces: DataFrame, keys: list[str], c: Cut = Cut()) -> DataFrame:
    """keys, ``samples`` (the components Z, N and E one after the other, zeros where there is none), ``valid`` and ``dropped`` (why, for each) of each window.

    traces: keys (which name one window of one station), channel, rate, offset_s (start after the window's) and samples,
    null or NaN where there is none. A component is merged from all its traces, in whatever order they come. A task
    holds one window of one station.
    """
    kinds = dict(traces.dtypes)
    n = round(c.seconds * c.rate)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", samples array<float>, valid array<boolean>, dropped array<string>"

    def run(held: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, list] = {}
        for channel, rate, start, x in zip(held["channel"], held["rate"], held["offset_s"], held["samples"]):
            if channel and x is not None and rate > 0:
                by.setdefault(channel[-1].upper(), []).append((channel, float(rate), float(start), np.array([np.nan if v is None else v for v in x], float)))
        out, why = np.zeros((len(ALIASES), n), np.float32), []
        for k, codes in enumerate(ALIASES.values()):
            found, reason = component_window(next((by[code] for code in codes if code in by), []), c)
            why.append(reason)
            if found is not None:
                out[k] = found
        return pd.DataFrame([(*held[keys].iloc[0], out.ravel().tolist(), [w is None for w in why], why)], columns=[*keys, "samples", "valid", "dropped"])

    return traces.select(*keys, "channel", "rate", "offset_s", "samples").groupBy(*keys).applyInPandas(run, schema)
