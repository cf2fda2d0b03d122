"""Checks that report every violation, and walks and differences of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each rule that holds, a null counting as not; one pass over the rows."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("rule"))


def paths(schema: StructType, prefix: str = "") -> list[str]:
    """Every leaf of a nested schema as a dotted path, depth first."""
    out: list[str] = []
    for field in schema.fields:
        out += paths(field.dataType, f"{prefix}{field.name}.") if isinstance(field.dataType, StructType) else [prefix + field.name]
    return out


def leaves(rows: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """(keys, path, value) of every leaf as text, nulls included."""
    names = [p for p in paths(rows.schema) if p not in keys and (within is None or p in within)]
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in names])
    return rows.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def record_diff(a: DataFrame, b: DataFrame, keys: list[str], volatile: Column | None = None) -> DataFrame:
    """Leaves that were added, removed or changed between two versions of records; volatile paths are left out."""
    left, right = leaves(a, keys).where("value is not null"), leaves(b, keys).where("value is not null")
    both = left.withColumnRenamed("value", "was").join(right.withColumnRenamed("value", "now"), [*keys, "path"], "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    out = both.withColumn("kind", kind).where("kind is not null")
    return (out if volatile is None else out.where(~volatile)).select(*keys, "path", "kind")


def interval_rules(low: str, best: str, high: str) -> dict[str, Column]:
    return {"low above high": F.col(low) > F.col(high), "best below low": F.col(best) < F.col(low), "best above high": F.col(best) > F.col(high)}


def spread(low: Column, mid: Column, high: Column, by: float = 1.5) -> tuple[Column, Column, Column]:
    """A strict interval: an end that isn't beyond the middle is put there by a factor."""
    return F.when(low < mid, low).otherwise(mid / by), mid, F.when(high > mid, high).otherwise(mid * by)


def union_interval(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], by: float = 1.5) -> tuple[Column, Column, Column, Column]:
    """Both intervals (low, median, high) in one, about the geometric mean of their medians, and the medians' ratio.

    The middle is kept strictly inside; where the ends meet they are put apart by a factor.
    """
    low, high = F.least(a[0], b[0]), F.greatest(a[2], b[2])
    mid = F.greatest(low * 1.0000001, F.least(high * 0.9999999, F.sqrt(a[1] * b[1])))
    strict = (low < mid) & (mid < high)
    return F.when(strict, low).otherwise(mid / by), mid, F.when(strict, high).otherwise(mid * by), a[1] / b[1]


def agreement(published: tuple[Column, Column, Column], low: Column, mid: Column, high: Column) -> Column:
    """Whether an interval agrees with a published one (low, best or null, high): struct of centre, width, both tests and the verdict.

    The published centre is its best value, else the geometric mean of positive ends, else the mean.
    """
    a, best, b = published
    centre = F.coalesce(best, F.when((a > 0) & (b > 0), F.sqrt(a * b)).otherwise((a + b) / 2))
    wide, mid_in, centre_in = b > a, mid.between(a, b), centre.between(low, high)
    return F.struct(centre.alias("centre"), wide.alias("has_width"), mid_in.alias("median_inside"), centre_in.alias("centre_inside"), ((mid_in | ~wide) & centre_in).alias("ok"))


def range_problems(low: Column, high: Column, best: Column, unit: Column, refs: Column, disputed: Column, estimates: Column, notes: Column) -> Column:
    """What is wrong with an interval, every rule that fails: bounds, best, references, units of its estimates (structs with unit), and what a disputed one needs."""
    other = F.exists(estimates, lambda e: ~e["unit"].eqNullSafe(unit))
    disputed = F.coalesce(disputed, F.lit(False))
    rules = {
        "low exceeds high": low > high,
        "best outside": best.isNotNull() & ~best.between(low, high),
        "duplicate references": F.size(F.array_distinct(refs)) < F.size(refs),
        "no reference": F.coalesce(F.size(refs), F.lit(0)) < 1,
        "unit of an estimate differs": F.coalesce(other, F.lit(False)),
        "disputed with best": disputed & best.isNotNull(),
        "disputed with fewer than two estimates": disputed & (F.coalesce(F.size(estimates), F.lit(0)) < 2),
        "disputed without notes": disputed & (F.coalesce(F.length(notes), F.lit(0)) == 0),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
