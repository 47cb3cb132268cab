"""Latency of rows per trigger type and batch, and progress reports as rows."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

ACCURACY = 100_000

_LAT = "STRUCT<P50: BIGINT, P90: BIGINT, P95: BIGINT, P99: BIGINT>"
PROGRESS = f"""STRUCT<batchId: BIGINT, numInputRows: BIGINT, processedRowsPerSecond: DOUBLE,
  latencies: STRUCT<e2eLatencyMs: {_LAT}, processingLatencyMs: {_LAT}, sourceQueuingLatencyMs: {_LAT}>,
  stateOperators: ARRAY<STRUCT<operatorName: STRING, numRowsTotal: BIGINT, numRowsUpdated: BIGINT,
    numRowsRemoved: BIGINT, commitTimeMs: BIGINT, memoryUsedBytes: BIGINT, customMetrics: MAP<STRING, BIGINT>>>>"""


def tag_for_latency(df: DataFrame, trigger_type: str, batch_id: int) -> DataFrame:
    """Sink time, trigger type and batch, added inside ``foreachBatch``."""
    return df.withColumns({
        "sink_timestamp": F.current_timestamp(), "triggertype": F.lit(trigger_type),
        "batch_id": F.lit(batch_id).cast("long")})


def row_latency(df: DataFrame, source: str = "timestamp", sink: str = "sink_timestamp") -> DataFrame:
    """Milliseconds from source to sink."""
    return df.withColumn("latency", F.unix_millis(sink) - F.unix_millis(source))


def latency_percentiles(df: DataFrame, by: str = "triggertype", batch: str = "batch_id") -> DataFrame:
    """Mean and p50/p95/p99 per trigger type and batch, batches numbered within their type.

    Percentile sketches are combined before the shuffle; only the finished batches are ranked.
    """
    p = lambda q: F.percentile_approx("latency", q, ACCURACY)
    stats = df.groupBy(by, batch).agg(
        F.avg("latency").alias("mean_latency"), p(0.5).alias("p50_latency"),
        p(0.95).alias("p95_latency"), p(0.99).alias("p99_latency"))
    # one row per finished batch: few enough for a plain window
    number = F.row_number().over(Window.partitionBy(by).orderBy(batch)).cast("long")
    return stats.withColumn("batchnumberfortriggertype", number)


def mean_after_warm_up(df: DataFrame, by: str, place: str, value: str, skip: int) -> DataFrame:
    """Mean of ``value`` per ``by`` over the rows placed behind the first ``skip``."""
    settled = df.filter(F.col(place) > skip)
    return settled.groupBy(by).agg(F.round(F.avg(value), 2).alias(value))


def collect_progress(query: StreamingQuery, max_batches: int, timeout: float = 120.0) -> list[str]:
    """Let a query run for some batches, stop it, and return its progress reports as JSON.  A query
    that ends by itself may have run fewer; one that is too slow raises ``TimeoutError``."""
    seen: dict[int, str] = {}
    deadline = time.monotonic() + timeout
    while query.isActive and len(seen) < max_batches and time.monotonic() < deadline:
        for p in query.recentProgress:
            seen.setdefault(p.batchId, p.json)
        time.sleep(0.2)
    late = query.isActive and len(seen) < max_batches
    if query.isActive:
        query.stop()
    if late:
        raise TimeoutError(f"{len(seen)} of {max_batches} batches in {timeout:g} s")
    return [seen[b] for b in sorted(seen)][:max_batches]


def progress_rows(spark: SparkSession, progress: list) -> DataFrame:
    """One typed row per progress report, with latencies and state operators where reported."""
    texts = [(p if isinstance(p, str) else json.dumps(p),) for p in progress]
    parsed = spark.createDataFrame(texts, "j STRING").select(F.from_json("j", PROGRESS).alias("p"))
    return parsed.select("p.*").withColumnRenamed("batchId", "batch_id")
