"""Quality rules inside a stream: kept, quarantined and counted rows of one batch number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weir.operators.quality import Rule, broken_rules, clean
from weir.session import folder_exists
from weir.streaming.sinks import to_batches

_BATCH, _KEPT, _BROKEN = "batch_no", "kept", "failed_rules"


class CheckedTable:
    """Rows that keep the rules, rows that break them and counts per rule, below one folder.

    A batch is written in one pass, every row either kept or quarantined with the names of the rules it
    breaks; its counts are taken from what was written and come last.  Readers look at batches with
    counts only, so the three always add up, also while a batch is written or repeated: a repeated one
    replaces its own files.  A broken ``fail`` rule stops the query before anything of the batch is there.
    """

    def __init__(self, path: str, rules: list[Rule]):
        self.path, self.rules = path, rules

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fails = [r for r in self.rules if r.action == "fail"]
        drops = [r.name for r in self.rules if r.action == "drop"]
        marked = clean(batch, fails).withColumn(_BROKEN, broken_rules(self.rules))
        kept = ~F.arrays_overlap(_BROKEN, F.array(*[F.lit(n) for n in drops]).cast("array<string>"))
        rows = f"{self.path}/rows/{_BATCH}={batch_id}"
        marked.withColumn(_KEPT, kept).write.mode("overwrite").partitionBy(_KEPT).parquet(rows)
        schema = StructType(list(marked.schema.fields)).add(_KEPT, "boolean")
        written = spark.read.schema(schema).parquet(rows)
        counts = written.agg(F.count(F.lit(1)).alias("rows"), *[
            F.count_if(F.array_contains(_BROKEN, r.name)).alias(f"f{i}") for i, r in enumerate(self.rules)])
        per_rule = F.array(*[F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), (F.col("rows") - F.col(f"f{i}")).alias("passed"),
            F.col(f"f{i}").alias("failed")) for i, r in enumerate(self.rules)])
        counts.select(F.inline(per_rule)).write.mode("overwrite").parquet(f"{self.path}/counts/{_BATCH}={batch_id}")

    def _rows(self, spark: SparkSession, kept: bool) -> DataFrame:
        done = spark.read.parquet(f"{self.path}/counts").select(_BATCH).distinct()
        rows = spark.read.parquet(f"{self.path}/rows").filter(F.col(_KEPT) == kept)
        return rows.join(done, _BATCH, "left_semi").drop(_BATCH, _KEPT)

    def kept(self, spark: SparkSession) -> DataFrame:
        """Rows that break no ``drop`` rule."""
        return self._rows(spark, True).drop(_BROKEN)

    def quarantined(self, spark: SparkSession) -> DataFrame:
        """The others, with the rules they break in ``failed_rules``."""
        return self._rows(spark, False)

    def metrics(self, spark: SparkSession, by_batch: bool = False) -> DataFrame:
        """Passed and failed rows per rule, over all batches or for each."""
        if not folder_exists(spark, f"{self.path}/counts"):
            return spark.createDataFrame([], "rule string, action string, passed long, failed long")
        counts = spark.read.parquet(f"{self.path}/counts")
        by = [_BATCH] if by_batch else []
        return counts.groupBy(*by, "rule", "action").agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))


def stream_checked(rows: DataFrame, table: CheckedTable, checkpoint: str) -> StreamingQuery:
    return to_batches(rows, table.apply, checkpoint)
