"""Feature vectors of waveform windows: spectra and envelopes of each trace in its task, aggregates over a window's traces by Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions import signal
from moraine.functions.signal import power_spectrum

TINY = 1e-30


@dataclass(frozen=True)
class Bands:
    """Half-open bands in Hz, sampling rate, and seconds of the envelope's box and of a centroid's segment."""

    rate: float = 20.0
    lp: tuple[float, float] = (0.01, 0.05)
    vlp: tuple[float, float] = (0.005, 0.01)
    sp: tuple[float, float] = (1.0, 5.0)
    mid: tuple[float, float] = (0.05, 1.0)
    smooth_s: float = 5.0
    segment_s: float = 30.0


def band_energy(at: np.ndarray, power: np.ndarray, band: tuple[float, float]) -> float:
    return float(power[(at >= band[0]) & (at < band[1])].sum())


def envelope(x: np.ndarray, b: Bands) -> np.ndarray:
    """Moving average of the absolute values, zeros beyond the ends."""
    width = max(1, int(b.smooth_s * b.rate))
    return np.convolve(np.abs(x), np.full(width, 1 / width), mode="same")


def rise_and_durations(env: np.ndarray, b: Bands) -> tuple[float, float, float]:
    """Seconds from 10 to 50 % of the peak, and seconds at 50 and at 20 % or more of it."""
    peak = env.max(initial=0.0)
    if peak <= 0:
        return 0.0, 0.0, 0.0
    first = [int(np.argmax(env >= share * peak)) for share in (0.1, 0.5)]
    return max(0, first[1] - first[0]) / b.rate, *(float((env >= share * peak).sum()) / b.rate for share in (0.5, 0.2))


def centroid_drift(x: np.ndarray, b: Bands) -> tuple[float, float]:
    """Mean spectral centroid over segments and its least-squares slope; zeros for fewer than three segments with energy."""
    step = int(b.segment_s * b.rate)
    found = []
    for start in range(0, len(x) - step + 1, step):
        at, power = power_spectrum(x[start : start + step], b.rate)
        if power.sum() > TINY:
            found.append(((start + step / 2) / b.rate, float((at * power).sum() / power.sum())))
    if len(found) < 3:
        return 0.0, 0.0
    t, c = np.array(found).T
    t = t - t.mean()
    return float(c.mean()), float((t * (c - c.mean())).sum() / (t * t).sum())


def trace_features(x: np.ndarray, b: Bands) -> dict[str, float]:
    """Twelve numbers of one trace."""
    at, power = power_spectrum(x, b.rate)
    total = float(power.sum()) + TINY
    lp, vlp, sp, mid = (band_energy(at, power, band) for band in (b.lp, b.vlp, b.sp, b.mid))
    ratio = lambda p, q: float(np.log10((p + TINY) / (q + TINY)))
    centre, drift = centroid_drift(x, b)
    env = envelope(x, b)
    rise, half, fifth = rise_and_durations(env, b)
    return {
        "log_lp_sp_ratio": ratio(lp, sp), "log_vlp_sp_ratio": ratio(vlp, sp), "log_lp_mid_ratio": ratio(lp, mid), "energy_fraction_lp": lp / total, "energy_fraction_sp": sp / total,
        "spectral_centroid_hz": centre, "centroid_drift_hz_per_s": drift, "spectral_spread_hz": float(np.sqrt(((at - centre) ** 2 * power).sum() / total)),
        "envelope_duration_50pc_s": half, "envelope_duration_20pc_s": fifth, "envelope_rise_10_50_s": rise, "envelope_peak_over_mean": (float(env.max()) + TINY) / (float(env.mean()) + TINY),
    }


def in_band(x: np.ndarray, band: tuple[float, float], rate: float) -> np.ndarray:
    spectrum, at = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(np.where((at >= band[0]) & (at < band[1]), spectrum, 0), n=len(x))


def slot_features(z: np.ndarray, n: np.ndarray | None, e: np.ndarray | None, b: Bands) -> tuple[dict[str, float], np.ndarray | None]:
    """The numbers of one receiver, and the normalised long-period envelope of its vertical trace."""
    out = {f"vert_{k}": v for k, v in trace_features(z, b).items()}
    if n is not None and e is not None:
        out |= {f"horiz_{k}": v for k, v in trace_features(np.hypot(n, e), b).items()}
        out["log_hv_energy_ratio"] = float(np.log10(((n * n).sum() + (e * e).sum() + TINY) / ((z * z).sum() + TINY)))
        parts = np.array([in_band(c, b.lp, b.rate) for c in (z, n, e)])
        size = np.abs(parts - parts.mean(1, keepdims=True)).max()
        out["lp_rectilinearity"] = min(1.0, max(0.0, signal.rectilinearity(*(parts / size)))) if size > 0 else 0.0
    env = envelope(in_band(z, b.lp, b.rate), b)
    return out, env / env.max() if env.max() > 0 else None


def stems() -> list[str]:
    one = list(trace_features(np.zeros(8), Bands(rate=1.0)))
    return [*(f"vert_{s}" for s in one), *(f"horiz_{s}" for s in one), "log_hv_energy_ratio", "lp_rectilinearity"]


def slot_table(slots: DataFrame, window: str, b: Bands = Bands()) -> DataFrame:
    """(window, features map, envelope) of each receiver. slots: window, z, n, e (arrays, null where not valid).

    Receivers without a vertical trace, or with one that is silent or not finite, take no part;
    horizontals count where both are there and finite.
    """
    fine = lambda x: x is not None and np.isfinite(x).all()
    kind = dict(slots.dtypes)[window]

    def run(batches):
        for batch in batches:
            rows = []
            for key, *parts in zip(batch[window], batch["z"], batch["n"], batch["e"]):
                z, n, e = (None if x is None else np.asarray(x, float) for x in parts)
                if fine(z) and z.any():
                    both = fine(n) and fine(e) and len(n) == len(e) == len(z)
                    found, env = slot_features(z, n if both else None, e if both else None, b)
                    rows.append((key, found, None if env is None else env.tolist()))
            yield pd.DataFrame(rows, columns=[window, "features", "envelope"])

    return slots.select(window, "z", "n", "e").mapInPandas(run, f"{window} {kind}, features map<string,double>, envelope array<double>")


def window_features(slots: DataFrame, window: str, b: Bands = Bands()) -> DataFrame:
    """window and 79 numbers: median, median absolute deviation and 90th percentile of each stem over receivers, and the coherence of envelopes.

    Windows in which no receiver takes part have zeros.
    """
    table = slot_table(slots, window, b)
    names = stems()
    wide = table.select(window, "envelope", *[F.col("features").getItem(s).alias(s) for s in names])
    middle = wide.groupBy(window).agg(*[F.median(s).alias(f"{s}_med") for s in names], *[F.percentile(s, F.lit(0.9)).alias(f"{s}_p90") for s in names])
    off = wide.join(middle, window).groupBy(window).agg(*[F.median(F.abs(F.col(s) - F.col(f"{s}_med"))).alias(f"{s}_mad") for s in names])
    alike = signal.mean_pair_correlation(table.where("envelope is not null"), window, "envelope").select(window, F.col("coherence").alias("lp_envelope_coherence"))
    every = slots.select(window).distinct()
    out = every.join(middle, window, "left").join(off, window, "left").join(alike, window, "left")
    order = [f"{s}_{a}" for s in names for a in ("med", "mad", "p90")]
    return out.select(window, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in [*order, "lp_envelope_coherence"]])
