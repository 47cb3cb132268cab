"""Version tables fed by streams of changes that may come late.

A version is named by its key and start.  A batch writes the versions it changes, under its own
number: those of its changes, and those before them, whose end moves to the new start.  A late change
so splits a version written long ago, and nothing else of the key is written again.  Of the rows with
one name the highest batch counts.  A repeated batch looks only at earlier ones and replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weir.operators.cdc import END, START
from weir.operators.latest import latest_rows, tie_number
from weir.operators.ordered import next_in_order, null_safe_left_join
from weir.session import folder_exists, pinned, remove_folder
from weir.streaming.sinks import to_batches

_BATCH, _TIE, _NEW = "batch_no", "_tie", "_new"


class VersionTable:
    """Versions of ``keys`` in a folder, ordered by the column ``seq`` (a number, date or timestamp).

    ``schema`` is that of the changes.  NULL keys are a key of their own; a change without ``seq`` has no
    place in an order and is left out.  Of several changes of one key and ``seq`` the one with the
    greatest hash of its other columns counts, whatever batches they come in.
    """

    def __init__(self, path: str, schema: StructType, keys: list[str], seq: str, delete_when: str | None = None):
        self.path, self.keys, self.seq, self.delete_when = path, keys, seq, delete_when
        self.columns = schema.names
        self.stored = StructType(list(schema.fields)).add(END, schema[seq].dataType).add(_TIE, "long").add(_BATCH, "long")

    def _versions(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The rows that count, of batches below ``before``."""
        if not folder_exists(spark, self.path):
            return spark.createDataFrame([], self.stored)
        rows = spark.read.schema(self.stored).parquet(self.path)
        if before is not None:
            rows = rows.filter(F.col(_BATCH) < before)
        return latest_rows(rows, [*self.keys, self.seq], [_BATCH])

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Take one batch of changes in.  What several steps need is stored, so that each step is done once."""
        spark = changes.sparkSession
        tied = changes.filter(F.col(self.seq).isNotNull()).withColumn(_TIE, tie_number(changes, [*self.keys, self.seq]))
        fresh = pinned(latest_rows(tied, [*self.keys, self.seq], [_TIE]), "fresh")
        touched = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
        known = pinned(self._versions(spark, batch_id).join(touched, same, "left_semi"), "known")
        # a change that is known already, or beaten by one of the same place, is dropped
        names = [*self.keys, self.seq]
        rival = null_safe_left_join(fresh, known.select(*names, F.col(_TIE).alias("_rival")), names)
        winning = rival.filter(F.col("_rival").isNull() | (F.col("_rival") < F.col(_TIE))).drop("_rival")
        beaten = winning.select(*[F.col(c).alias(f"_w_{c}") for c in names])
        over = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in names]
        kept = known.join(beaten, over, "left_anti").withColumn(_NEW, F.lit(False)).withColumnRenamed(END, "_was")
        both = kept.drop(_BATCH).unionByName(
            winning.withColumns({_NEW: F.lit(True), "_was": F.lit(None).cast(self.stored[END].dataType)}))
        chained = next_in_order(pinned(both, "versions"), self.keys, [self.seq], END)
        moved = chained.filter(F.col(_NEW) | ~F.col(END).eqNullSafe(F.col("_was")))
        moved.select(*self.columns, END, _TIE).write.mode("overwrite").parquet(f"{self.path}/{_BATCH}={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """Every version with its half-open validity; a delete ends a version and starts none."""
        rows = self._versions(spark)
        if self.delete_when:
            rows = rows.filter(f"NOT coalesce({self.delete_when}, false)")
        return rows.withColumn(START, F.col(self.seq)).select(*self.columns, START, END)

    def compact(self, spark: SparkSession, to: str) -> "VersionTable":
        """The same table in the folder ``to``, all batches in one.  Later batches go on there; until the
        feed is pointed to it the old folder stays whole."""
        after = VersionTable(to, StructType([self.stored[c] for c in self.columns]), self.keys, self.seq, self.delete_when)
        remove_folder(spark, f"{to}/{_BATCH}=-1")
        self._versions(spark).drop(_BATCH).write.parquet(f"{to}/{_BATCH}=-1")
        return after


def stream_versions(changes: DataFrame, table: VersionTable, checkpoint: str) -> StreamingQuery:
    """Feed a version table from a stream of changes."""
    return to_batches(changes, table.apply, checkpoint)
