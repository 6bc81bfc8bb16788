"""Input tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the largest table that is dealt to all cores.
SMALL = 256 * 1024 * 1024


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, in whatever store Spark reads.

    A table of at most ``SMALL`` bytes in files, in fewer splits than there are cores, is dealt to all of
    them; a larger one is never shuffled here.
    """
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return frame.repartition(cores) if size <= SMALL and frame.rdd.getNumPartitions() < cores else frame
