"""Stream latency reports: a sink row is an event, its latency the whole part of its value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.registry import query
from weir.streaming.latency import latency_percentiles, mean_after_warm_up
from weir.tables import load

_ROWS = """(SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'processingtime0' ELSE 'realtime' END AS triggertype,
  CAST(day(ts) AS BIGINT) AS batch_id, CAST(floor(value) AS BIGINT) AS latency FROM events)"""
_STATS = f"""SELECT triggertype, batch_id, avg(latency) AS mean_latency, quantile_disc(latency, 0.5) AS p50_latency,
  quantile_disc(latency, 0.95) AS p95_latency, quantile_disc(latency, 0.99) AS p99_latency,
  dense_rank() OVER (PARTITION BY triggertype ORDER BY batch_id) AS batchnumberfortriggertype
  FROM {_ROWS} GROUP BY triggertype, batch_id"""


def sink_rows(spark, d) -> DataFrame:
    batch = F.col("event_type").isin("click", "view", "purchase")
    return load(spark, d, "events").select(
        F.when(batch, "processingtime0").otherwise("realtime").alias("triggertype"),
        F.dayofmonth("ts").cast("long").alias("batch_id"), F.floor("value").cast("long").alias("latency"))


@query("latency_percentiles", _STATS)
def percentiles(spark, d) -> DataFrame:
    return latency_percentiles(sink_rows(spark, d))


@query("latency_mode_compare", f"""
  SELECT triggertype, round(avg(p99_latency), 2) AS p99_latency FROM ({_STATS}) WHERE batchnumberfortriggertype NOT IN (1, 2) GROUP BY 1""")
def mode_compare(spark, d) -> DataFrame:
    rows = sink_rows(spark, d)
    one, other = rows.filter("triggertype = 'processingtime0'"), rows.filter("triggertype = 'realtime'")
    finished = latency_percentiles(one).union(latency_percentiles(other))
    return mean_after_warm_up(finished, "triggertype", "batchnumberfortriggertype", "p99_latency", skip=2)
