"""Spectral kernels over Arrow arrays; each row is one signal and stays in its task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def power_spectrum(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power of a trace without its mean, after a Hann window."""
    x = np.asarray(x, float)
    return np.fft.rfftfreq(len(x), 1 / rate), np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2


def band_energies(x: np.ndarray, rate: float, *bands: tuple[float, float]) -> tuple[float, ...]:
    """Energy in closed bands."""
    at, power = power_spectrum(x, rate)
    return tuple(float(power[(at >= low) & (at <= high)].sum()) for low, high in bands)


def band_ratio(x: np.ndarray, rate: float, low: tuple[float, float], high: tuple[float, float]) -> float:
    """Energy in one closed band over that in another; infinite if only the second is empty."""
    x = np.asarray(x, float)
    if not len(x):
        return float("nan")
    a, b = band_energies(x, rate, low, high)
    return float(a / b) if b > 0 else float("inf") if a > 0 else 0.0


def spectrum_summary(x: np.ndarray, rate: float) -> tuple[float, float, float, float]:
    """Total energy, dominant frequency, centroid and bandwidth of the one-sided spectrum."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return 0.0, 0.0, 0.0, 0.0
    power, at = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x), np.fft.rfftfreq(len(x), 1 / rate)
    power[1 : len(power) - (len(x) % 2 == 0)] *= 2
    total = power.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0, 0.0
    centre = (at * power).sum() / total
    return float(total), float(at[power.argmax()]), float(centre), float(np.sqrt(((at - centre) ** 2 * power).sum() / total))


def rectilinearity(z: np.ndarray, n: np.ndarray, e: np.ndarray) -> float:
    values = np.sort(np.linalg.eigvalsh(np.cov(np.vstack([z, n, e]))))[::-1]
    return float(1 - (values[1] + values[2]) / (2 * values[0])) if values[0] > 0 else 0.0


def band_ratio_udf(rate: float, low: tuple[float, float], high: tuple[float, float]):
    @pandas_udf("double")
    def ratio(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else band_ratio(x, rate, low, high)).astype(float)

    return ratio


def spectrum_udf(rate: float):
    @pandas_udf("energy double, dominant double, centroid double, bandwidth double")
    def summary(xs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([spectrum_summary(() if x is None else x, rate) for x in xs], columns=["energy", "dominant", "centroid", "bandwidth"])

    return summary


def rectilinearity_udf():
    @pandas_udf("double")
    def linear(z: pd.Series, n: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([rectilinearity(*x) for x in zip(z, n, e)], dtype=float)

    return linear


def mean_pair_correlation(rows: DataFrame, key: str, x: str) -> DataFrame:
    """(key, n_pairs, coherence): mean correlation over all pairs of arrays of equal length; constant arrays take no part.

    The squared sum of unit vectors holds the products of all pairs, so none is formed.
    """
    sums = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v.cast("double") * v).alias("q")))
    scaled = rows.select(key, x, sums.alias("m")).select(key, x, (F.col("m.s") / F.size(x)).alias("mean"), F.sqrt(F.col("m.q") - F.col("m.s") * F.col("m.s") / F.size(x)).alias("norm")).where("norm > 0")
    points = scaled.select(key, "mean", "norm", F.posexplode(x).alias("i", "v")).groupBy(key, "i").agg(F.sum((F.col("v") - F.col("mean")) / F.col("norm")).alias("s"), F.count("*").cast("double").alias("n"))
    pairs = F.max("n") * (F.max("n") - 1) / 2
    return points.groupBy(key).agg(pairs.cast("long").alias("n_pairs"), F.when(pairs > 0, (F.sum(F.col("s") * F.col("s")) - F.max("n")) / (2 * pairs)).alias("coherence"))


def match_chip(reference: np.ndarray, secondary: np.ndarray, reach: int) -> tuple[float, float, float]:
    """Shift (rows, columns) of the second chip against the first, and the height of the peak over the mean correlation, as a share of it.

    Gradients, scaled to directions, are correlated; the peak within ``reach`` is refined by a parabola on each
    axis. Chips without texture, and a peak on the rim of the search, are no measurement and give zeros.
    """

    def directions(x: np.ndarray) -> np.ndarray:
        down, across = np.gradient(np.asarray(x, float))
        size = np.hypot(down, across)
        return np.divide(across + 1j * down, size, out=np.zeros(size.shape, complex), where=size > 0)

    a, b = directions(reference), directions(secondary)
    if not a.any() or not b.any():
        return 0.0, 0.0, 0.0
    height = np.abs(np.fft.ifft2(np.fft.fft2(b) * np.fft.fft2(a).conj()))
    shifts = [np.arange(max(-(n // 2), -reach), min((n + 1) // 2 - 1, reach) + 1) for n in height.shape]
    searched = height[np.ix_(*shifts)]  # negative shifts are at the far end
    best = np.unravel_index(int(searched.argmax()), searched.shape)
    if any(i in (0, len(s) - 1) for i, s in zip(best, shifts)):
        return 0.0, 0.0, 0.0
    out = []
    for axis in (0, 1):
        low, top, high = (searched[tuple(i + (k if n == axis else 0) for n, i in enumerate(best))] for k in (-1, 0, 1))
        bend = low - 2 * top + high
        out.append(float(shifts[axis][best[axis]] + (0.5 * (low - high) / bend if bend else 0.0)))
    mean = height.mean()
    return *out, float((searched[best] - mean) / mean) if mean > 0 else 0.0


def match_chip_udf(side: int, reach: int):
    """Shifts of flat square chips of that side."""

    @pandas_udf("dy double, dx double, peak double")
    def match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [match_chip(np.reshape(x, (side, side)), np.reshape(y, (side, side)), reach) if x is not None and y is not None and len(x) == len(y) == side * side else (None,) * 3 for x, y in zip(a, b)]
        return pd.DataFrame(found, columns=["dy", "dx", "peak"], dtype=float)

    return match
