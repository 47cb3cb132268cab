"""Upserts, updates and deletes on a stored partitioned table: only touched partitions are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weir.operators.cdc import conditional_update, delete_where, upsert
from weir.session import pinned, remove_folder


class PartitionedTable:
    """A parquet folder partitioned by one column that each row's key determines.

    Every change makes the new rows of the touched partitions first and stores them beside the table,
    then replaces just these partitions.  All three are safe to run again after a failure: the stored
    rows do not depend on a half replaced table, and a second run gives the same rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition: str):
        self.spark, self.path, self.schema, self.partition = spark, path, schema, partition

    def create(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").partitionBy(self.partition).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def _within(self, touched: list) -> DataFrame:
        """The rows of some partitions; the others' files are not opened."""
        known = [v for v in touched if v is not None]
        inside = F.col(self.partition).isin(known) if known else F.lit(False)
        return self.read().filter(inside | F.col(self.partition).isNull() if None in touched else inside)

    def _replace(self, touched: list, rows: DataFrame) -> None:
        """Put ``rows`` in the place of the touched partitions.  Only partition names come to the driver."""
        ready = pinned(rows.select(*self.schema.names), "partitions")
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self.path)
        left = {r[0] for r in ready.select(self.partition).distinct().collect()}
        for value in touched:
            if value not in left:
                name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
                remove_folder(self.spark, f"{self.path}/{self.partition}={name}")

    def _touched(self, rows: DataFrame) -> list:
        return [r[0] for r in rows.select(self.partition).distinct().collect()]

    def upsert(self, updates: DataFrame, keys: list[str]) -> None:
        """Matched keys take all columns of ``updates``, new keys are added."""
        touched = self._touched(updates)
        if touched:
            self._replace(touched, upsert(self._within(touched), updates.select(*self.schema.names), keys))

    def delete(self, where: str) -> None:
        touched = self._touched(self.read().filter(f"coalesce({where}, false)"))
        if touched:
            self._replace(touched, delete_where(self._within(touched), where))

    def update(self, where: str, assignments: dict[str, str]) -> None:
        if self.partition in assignments:
            raise ValueError(f"{self.partition} places the rows and cannot be assigned")
        touched = self._touched(self.read().filter(f"coalesce({where}, false)"))
        if touched:
            self._replace(touched, conditional_update(self._within(touched), where, assignments))
