"""Loading of the supplied star-schema tables with the types the analytics expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; columns are pruned and filters pushed by the scan itself."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """NaN marks a missing measurement in the sources; Spark aggregates skip only NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})
