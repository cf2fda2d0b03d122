"""Least squares over many traces: normal equations add up, so tasks send sums of a fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def design(kernel: np.ndarray, n_basis: int) -> np.ndarray:
    """The kernel shifted once for each basis function, causally."""
    out = np.zeros((len(kernel), n_basis))
    for k in range(n_basis):
        out[k:, k] = kernel[: len(kernel) - k]
    return out


def normal_equations(traces: DataFrame, n_basis: int) -> DataFrame:
    """(i, j, value) of the sum of AtA, and of Atd in column j = n_basis, over traces (kernel, data)."""

    def run(batches):
        total = np.zeros((n_basis, n_basis + 1))
        for batch in batches:
            for kernel, data in zip(batch["kernel"], batch["data"]):
                a = design(np.array(kernel.as_py(), float), n_basis)
                total[:, :n_basis] += a.T @ a
                total[:, n_basis] += a.T @ np.array(data.as_py(), float)
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "value"])

    return traces.select("kernel", "data").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def solve(equations: DataFrame, n_basis: int, damping: tuple[float, ...]) -> list[tuple[float, np.ndarray]]:
    """Tikhonov solutions of equations of fixed size, for each damping relative to the mean diagonal."""
    full = np.zeros((n_basis, n_basis + 1))
    for i, j, value in equations.collect():
        full[i, j] = value
    ata, atd = full[:, :n_basis], full[:, n_basis]
    scale = np.trace(ata) / n_basis or 1.0
    return [(d, np.linalg.solve(ata + d * scale * np.eye(n_basis), atd)) for d in damping]


def corner(misfits: list[float], norms: list[float]) -> int:
    """The inner point of greatest signed curvature of the curve of misfit against solution norm, both in logarithms."""
    x, y = (np.log(np.maximum(v, 1e-300)) for v in (misfits, norms))
    dx, dy = np.gradient(x), np.gradient(y)
    size = (dx * dx + dy * dy) ** 1.5
    bend = np.divide(dx * np.gradient(dy) - dy * np.gradient(dx), size, out=np.zeros_like(x), where=size > 0)
    return 1 + int(bend[1:-1].argmax()) if len(x) > 2 else int(bend.argmax())
