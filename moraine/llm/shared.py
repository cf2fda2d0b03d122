"""The folder that the cluster shares, cutting of lineage in it, and removal of what is done with."""

from __future__ import annotations

from pyspark.sql import SparkSession

from moraine.checkpoints import cut, shared_folder

__all__ = ["cut", "remove", "shared_folder"]


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this session wrote, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
