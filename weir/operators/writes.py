"""Writing batch tables: replace, append under a growing schema, fill once, cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def replace_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0) -> None:
    """Replace a catalog table, schema included; bucketing lets later joins on the column skip a shuffle."""
    writer = df.write.mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def load_csv(spark: SparkSession, path: str, name: str, header: bool = True) -> None:
    """Replace a catalog table, schema included, by CSV files with inferred types."""
    replace_table(spark.read.option("header", header).option("inferSchema", True).csv(path), name)


def append_table(df: DataFrame, name: str) -> None:
    """Append to a catalog table; columns it does not have yet are added, those ``df`` lacks are NULL."""
    spark = df.sparkSession
    known = {f.name: f.dataType for f in spark.table(name).schema}
    new = [f for f in df.schema if f.name not in known]
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
    missing = {c: F.lit(None).cast(t) for c, t in known.items() if c not in df.columns}
    order = [*known, *[f.name for f in new]]
    df.withColumns(missing).select(*order).write.mode("append").insertInto(name)


def fill_if_empty(spark: SparkSession, name: str, rows: DataFrame) -> bool:
    """Load a table once: nothing happens if it already holds rows."""
    if spark.catalog.tableExists(name) and not spark.table(name).isEmpty():
        return False
    rows.write.mode("overwrite").saveAsTable(name)
    return True


def append_evolving(df: DataFrame, path: str) -> None:
    """Append files whose columns may differ from the earlier ones."""
    df.write.mode("append").parquet(path)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """All columns any file has; a file without a column gives NULLs."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_clustered(df: DataFrame, path: str, partition: str, order: list[str], mode: str = "error") -> None:
    """Partition by one column and sort files by ``order``, so that reads prune partitions and
    row groups.  ``rebalance`` evens file sizes out and splits a partition that is large."""
    spread = df.hint("rebalance", partition).sortWithinPartitions(partition, *order)
    spread.write.mode(mode).partitionBy(partition).parquet(path)
