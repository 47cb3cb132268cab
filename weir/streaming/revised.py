"""Aggregates kept up to date under inserts, updates and deletes.

Sums can be added up from new rows alone; the least, the greatest and the number of different values
can not, as a row that goes may take them along.  So next to the result the table keeps the last
image of every row and, per group, how many rows hold each value.  A batch turns into signed counts:
what its rows said before goes out, what they say now comes in.  Only groups it touches are computed
again, from their value counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weir.operators.latest import latest_rows
from weir.operators.ordered import null_safe_left_join
from weir.session import folder_exists, pinned
from weir.streaming.sinks import to_batches

_BATCH, _GONE = "batch_no", "gone"


class RevisedTotals:
    """Per group: ``rows``, ``total``, ``least``, ``greatest`` and ``different`` values, exact.

    ``schema`` describes the changes: the columns ``key`` of a row, ``by`` of its group, a whole-number
    ``value``, a number ``seq`` (the greater one is the later state of a key, whatever batch it comes
    in) and a boolean ``gone`` for deletes.  NULL groups are a group; NULL values count as rows only.
    Batches write under their number and look at earlier ones, so a repeated batch changes nothing.
    """

    def __init__(self, path: str, schema: StructType, key: list[str], by: list[str], value: str = "value", seq: str = "seq"):
        self.path, self.key, self.by, self.value, self.seq = path, key, by, value, seq
        fields = {f.name: f for f in schema}
        named = [*key, seq, *by, value]
        self.images = StructType([fields[c] for c in named]).add(_GONE, "boolean").add(_BATCH, "long")
        self.counts = StructType([fields[c] for c in by]).add(value, "long").add("n", "long").add(_BATCH, "long")
        self.results = StructType([fields[c] for c in by])
        for c in ("rows", "total", "least", "greatest", "different", _BATCH):
            self.results = self.results.add(c, "long")

    def _stored(self, spark: SparkSession, part: str, schema: StructType, before: int | None = None) -> DataFrame:
        folder = f"{self.path}/{part}"
        if not folder_exists(spark, folder):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(folder)
        return rows if before is None else rows.filter(F.col(_BATCH) < before)

    def _write(self, rows: DataFrame, part: str, batch_id: int) -> DataFrame:
        """Store a batch's rows of one part; what was stored."""
        folder = f"{self.path}/{part}/{_BATCH}={batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        return rows.sparkSession.read.schema(rows.schema).parquet(folder)

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        columns = [c for c in self.images.names if c != _BATCH]
        gone = F.coalesce(_GONE, F.lit(False)).alias(_GONE)
        # what several steps need is stored first: each is done once, and all start from the same rows
        fresh = pinned(latest_rows(changes.select(*[c for c in columns if c != _GONE], gone), self.key, [self.seq]), "fresh")
        asked = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in self.key])
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.key]
        before = self._stored(spark, "images", self.images, batch_id).join(asked, same, "left_semi")
        old = pinned(latest_rows(before, self.key, [_BATCH]).drop(_BATCH), "old")
        seen = null_safe_left_join(fresh, old.select(*self.key, F.col(self.seq).alias("_seen")), self.key)
        newer = seen.filter(F.col("_seen").isNull() | (F.col("_seen") < F.col(self.seq))).drop("_seen")
        images = self._write(newer, "images", batch_id)
        replaced = old.join(images.select(*[F.col(k).alias(f"_k_{k}") for k in self.key]), same, "left_semi")
        signed = images.withColumn("n", F.lit(1)).unionByName(replaced.withColumn("n", F.lit(-1))).filter(~F.col(_GONE))
        moves = signed.groupBy(*self.by, F.col(self.value).cast("long").alias(self.value)).agg(
            F.sum("n").alias("n")).filter("n <> 0")
        moves = self._write(moves, "counts", batch_id)
        touched = moves.select(*self.by).distinct()
        alike = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in self.by]
        groups = touched.select(*[F.col(c).alias(f"_b_{c}") for c in self.by])
        held = self._stored(spark, "counts", self.counts, batch_id).drop(_BATCH).join(groups, alike, "left_semi")
        values = held.unionByName(moves).groupBy(*self.by, self.value).agg(F.sum("n").alias("n")).filter("n > 0")
        v = F.col(self.value)
        again = values.groupBy(*self.by).agg(
            F.sum("n").alias("rows"), F.sum(F.col("n") * v).alias("total"), F.min(v).alias("least"),
            F.max(v).alias("greatest"), F.count(v).alias("different"))
        results = null_safe_left_join(touched, again, self.by)
        self._write(results.select(*self.by, F.coalesce("rows", F.lit(0)).alias("rows"), "total", "least", "greatest", "different"),
                    "results", batch_id)

    def read(self, spark: SparkSession) -> DataFrame:
        """The groups that hold rows."""
        rows = latest_rows(self._stored(spark, "results", self.results), self.by, [_BATCH])
        return rows.filter("rows > 0").drop(_BATCH)


def stream_revised(changes: DataFrame, table: RevisedTotals, checkpoint: str) -> StreamingQuery:
    return to_batches(changes, table.apply, checkpoint)
