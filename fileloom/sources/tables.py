"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A small input that Spark reads in fewer tasks than it has cores, dealt to all of them; any other as it is.

    A file of one row group cannot be split, so that one core would convert it all.
    """
    if not hasattr(df, "_jdf"):  # Spark Connect does not say how many tasks a plan has
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
