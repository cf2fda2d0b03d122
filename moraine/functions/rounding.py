"""Rounding of doubles as SQL does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 6) -> Column:
    """x times 10^digits, rounded half away from zero, divided again.

    F.round takes the shortest decimal that names a double: 0.1301655 is a tie for it, though 1e6 times this double is 130165.49999999999.
    """
    scale = F.lit(10.0**digits)
    return F.round((F.col(x) if isinstance(x, str) else x) * scale) / scale
