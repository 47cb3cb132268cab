"""Tables fed by streams: append, full refresh, current rows per key, running aggregates.

Per-batch results go to a folder named after the batch and replace it when the batch is
repeated, so a restart adds nothing twice.  Readers combine the batches; ``compact`` folds
them into one when they have become many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.operators.cdc import delete_where, latest_per_key, merge_partials
from weir.session import remove_folder
from weir.streaming.sinks import start, to_batches

_BATCH = "batch_no"


def append_new(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Process what is new since the last run and append it to a parquet table."""
    query = start(stream, "parquet", checkpoint, path=table)
    query.awaitTermination()
    return query


def full_refresh(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Recompute a table from its whole source: what the table and its checkpoint held is removed first."""
    spark = stream.sparkSession
    remove_folder(spark, checkpoint)
    remove_folder(spark, table)
    return append_new(stream, table, checkpoint)


def _write_batch(path: str, prepare):
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")
    return write


def _read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BATCH)


def update_table(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the changed result rows of every batch (update mode).  The highest ``batch_no``
    of a key is its current row."""
    return to_batches(results, _write_batch(path, lambda b: b), checkpoint, "update")


def stream_scd1(changes: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest change per key of every batch, deletes included (as tombstones)."""
    return to_batches(
        changes, _write_batch(path, lambda b: latest_per_key(b, keys, [seq])), checkpoint)


def read_scd1(spark, path: str, keys: list[str], seq: str, delete_when: str | None = None, except_cols=()) -> DataFrame:
    """Current rows: highest sequence wins whatever batch it came in."""
    last = latest_per_key(_read_batches(spark, path), keys, [seq])
    return (delete_where(last, delete_when) if delete_when else last).drop(*except_cols)


def stream_sums(rows: DataFrame, path: str, by: list[str], values: list[str], checkpoint: str) -> StreamingQuery:
    """Partial row counts and sums of every batch."""
    def partial(b: DataFrame) -> DataFrame:
        return b.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values])
    return to_batches(rows, _write_batch(path, partial), checkpoint)


def read_sums(spark, path: str, by: list[str], values: list[str]) -> DataFrame:
    return merge_partials([_read_batches(spark, path)], by, ["n", *values])


def compact(combined: DataFrame, path: str) -> None:
    """Write combined batches as batch -1 of a new table; later batches can be added to it."""
    combined.write.parquet(f"{path}/{_BATCH}=-1")
