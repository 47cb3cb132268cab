"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: use all cores when the input has fewer splits than that
    (few files, or files that cannot be split).  Large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short table written in code.  Its size is fixed, so joins may broadcast it."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def with_instant(df: DataFrame, *cols: str) -> DataFrame:
    """Zone-less timestamps as instants (UTC), as watermarks and epoch functions need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})
