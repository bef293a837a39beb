"""Parquet tables as input of costly per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table in at least as many partitions as there are cores.

    A large table has far more splits than that and is returned as it is read. A small one, often
    a single row group, would leave all cores but one idle in text metrics or generation; it is
    dealt out, which costs a shuffle of a small table. Filters and column selections still reach
    the scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
