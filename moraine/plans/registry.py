"""All queries of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.plans import catalog, checks, estimates, evaluation, hazard, ledger, records, reports, rules, scenes, solvers, terrain, watch  # noqa: F401
from moraine.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["watch_tiers_walkforward"](spark, sf_dir)
