"""Session factory used by tests, the benchmark and ad-hoc runs.

On a cluster the session comes from ``spark-submit``; nothing below is needed there.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, partitions: int | None = None, app: str = "moraine") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or (8 if cores == "*" else cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
