"""Streaming forms: the tables arrive in two portions, each drained by a run of its own on the
same checkpoint; results are checked against the batch definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import cents
from weir.operators.cdc import latest_per_key
from weir.plans import changes, loans, telemetry, wealth
from weir.registry import ORACLES, query
from weir.session import shared_dir
from weir.streaming import latency, sinks
from weir.streaming.monitor import monitor_stream, monitor_table
from weir.streaming.tables import append_new, compact, full_refresh, read_scd1, read_sums, stream_scd1, stream_sums, update_table
from weir.streaming.windows import sliding_stats
from weir.tables import load, with_instant


def two_portions(spark, rows: DataFrame, first, run) -> str:
    """Append the portions to a landing table and call ``run(stream, folder)`` after each."""
    work = shared_dir(spark, "stream")
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(f"{work}/landing")
        run(spark.readStream.schema(rows.schema).parquet(f"{work}/landing"), work).awaitTermination()
    return work


@query("stream_sliding_windows", ORACLES["sliding_window_stats"])
def stream_sliding_windows(spark, d) -> DataFrame:
    """Update mode: every change of a window is stored, its last state read back."""
    e = with_instant(load(spark, d, "events").select("ts", "value", "event_type"), "ts").withColumn(
        "value", F.rint(F.col("value") * 100))
    stats = lambda s: sliding_stats(s, "ts", "value", "1 hour", "10 minutes", watermark="60 days")
    work = two_portions(
        spark, e, F.col("event_type") == "view",
        lambda s, w: update_table(stats(s), f"{w}/table", f"{w}/checkpoint"))
    last = latest_per_key(spark.read.parquet(f"{work}/table"), ["window_start", "window_end"], ["batch_no"])
    return last.drop("batch_no")


@query("stream_env_monitor", ORACLES["env_monitor"])
def stream_env_monitor(spark, d) -> DataFrame:
    """Keyed state carried from the first half of the month to the second."""
    rows = with_instant(telemetry.sensors(spark, d), "ts")
    work = two_portions(
        spark, rows, F.col("ts") < F.lit("2024-01-16").cast("timestamp"),
        lambda s, w: update_table(monitor_stream(s, "city", "ts", "event_id"), f"{w}/table", f"{w}/checkpoint"))
    return spark.read.parquet(f"{work}/table").select(
        "event_id", "city", F.col("hourly_avg_temp").alias("avg_temp"),
        F.col("temperature_trend").alias("trend"), "high_temp_count")


@query("stream_env_monitor_table", ORACLES["env_monitor"])
def stream_env_monitor_table(spark, d) -> DataFrame:
    """The same with the state kept as a table, which lets a hot key be split."""
    work = two_portions(
        spark, telemetry.sensors(spark, d), F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"),
        lambda s, w: monitor_table(s, f"{w}/table", "city", "ts", "event_id", f"{w}/checkpoint"))
    return spark.read.parquet(f"{work}/table/rows").select(
        "event_id", "city", F.col("hourly_avg_temp").alias("avg_temp"),
        F.col("temperature_trend").alias("trend"), "high_temp_count")


@query("stream_scd1", ORACLES["cdc_scd1_delete"])
def streamed_scd1(spark, d) -> DataFrame:
    """Changes out of order across runs: the highest sequence wins, deletes included."""
    work = two_portions(
        spark, changes.feed(spark, d), F.col("event_type").isin("error", "view"),
        lambda s, w: stream_scd1(s, f"{w}/table", ["user_id"], "event_id", f"{w}/checkpoint"))
    return read_scd1(spark, f"{work}/table", ["user_id"], "event_id", changes.DELETE, ["event_id"])


@query("stream_incremental_sums", ORACLES["incremental_agg"])
def streamed_sums(spark, d) -> DataFrame:
    orders = load(spark, d, "orders").select(
        "o_custkey", "o_orderstatus", cents(F.col("o_totalprice")).alias("cents"))
    work = two_portions(
        spark, orders, F.col("o_orderstatus") == "F",
        lambda s, w: stream_sums(s, f"{w}/table", ["o_custkey"], ["cents"], f"{w}/checkpoint"))
    return read_sums(spark, f"{work}/table", ["o_custkey"], ["cents"])


@query("stream_sums_compacted", ORACLES["incremental_agg"])
def streamed_sums_compacted(spark, d) -> DataFrame:
    """The same with the batches of the first run folded into one, to which the second run adds its own."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderstatus", cents(F.col("o_totalprice")).alias("cents"))
    work, first = shared_dir(spark, "folded"), F.col("o_orderstatus") == "F"
    read = lambda: spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/landing")
    orders.filter(first).repartition(3).write.parquet(f"{work}/landing")
    stream_sums(read(), f"{work}/batches", ["o_custkey"], ["cents"], f"{work}/checkpoint").awaitTermination()
    compact(read_sums(spark, f"{work}/batches", ["o_custkey"], ["cents"]), f"{work}/table")
    orders.filter(~first).coalesce(1).write.mode("append").parquet(f"{work}/landing")
    stream_sums(read(), f"{work}/table", ["o_custkey"], ["cents"], f"{work}/checkpoint").awaitTermination()
    return read_sums(spark, f"{work}/table", ["o_custkey"], ["cents"])


@query("stream_net_worth", """
  SELECT o_custkey AS customer_id, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS total_net_worth FROM orders GROUP BY 1""")
def streamed_worth(spark, d) -> DataFrame:
    """Running sum per customer in update mode."""
    rows = wealth.portfolio(spark, d).withColumn("portfolio_value", F.floor("portfolio_value").cast("double"))
    work = two_portions(
        spark, rows, F.col("portfolio_value") < 200_000,
        lambda s, w: update_table(wealth.net_worth_of(s), f"{w}/table", f"{w}/checkpoint"))
    last = latest_per_key(spark.read.parquet(f"{work}/table"), ["customer_id"], ["batch_no"])
    return last.drop("batch_no")


@query("stream_static_join", "SELECT o_orderkey, accounting_treatment FROM (" + ORACLES["loan_enrich"] + ")")
def stream_static_join(spark, d) -> DataFrame:
    """New orders joined with the literal reference table as they arrive."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    code = F.left("o_orderpriority", F.lit(1)).cast("int")
    joined = lambda s: loans.enrich(s, loans.treatments(spark), code).select("o_orderkey", "accounting_treatment")
    work = two_portions(
        spark, rows, F.col("o_orderstatus") == "O",
        lambda s, w: sinks.start(joined(s), "parquet", f"{w}/checkpoint", path=f"{w}/table"))
    return spark.read.parquet(f"{work}/table")


@query("stream_payload_sink", ORACLES["kafka_payload_json"])
def stream_payload_sink(spark, d) -> DataFrame:
    """Filter, project and write message payloads (to text files here, to a topic with its connector)."""
    rows = load(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_suppkey").alias("franchise"), F.col("l_returnflag").alias("flag"), "l_extendedprice")
    high = lambda s: s.filter("l_extendedprice > 25000").select(sinks.payload("product", "quantity", "franchise", "flag"))
    work = two_portions(
        spark, rows, F.col("flag") == "R",
        lambda s, w: sinks.start(high(s), "text", f"{w}/checkpoint", path=f"{w}/table"))
    return spark.read.text(f"{work}/table")


@query("stream_full_refresh", "SELECT event_id, event_type || '!' AS event_type FROM events")
def stream_full_refresh(spark, d) -> DataFrame:
    """A table appended to by two runs, then recomputed from its whole source under a new rule."""
    rows = load(spark, d, "events").select("event_id", "event_type")
    work = two_portions(spark, rows, F.col("event_type") == "view", lambda s, w: append_new(s, f"{w}/table", f"{w}/checkpoint"))
    again = spark.readStream.schema(rows.schema).parquet(f"{work}/landing").withColumn("event_type", F.concat("event_type", F.lit("!")))
    full_refresh(again, f"{work}/table", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/table")


_LATE = """
  WITH e AS (SELECT epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents, event_type = 'view' AS early FROM events),
  limits AS (SELECT max(us) // 1000 - 10000 AS w FROM e WHERE early),
  hits AS (SELECT (us // 2000000 - k) * 2 AS s, cents, early FROM e, (SELECT unnest(range(0, 5)) AS k))
  SELECT s AS window_second, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents
  FROM hits, limits WHERE early OR (s + 10) * 1000 > w GROUP BY 1"""


@query("stream_late_rows", _LATE)
def stream_late_rows(spark, d) -> DataFrame:
    """Windows of 10 s every 2 s under a watermark of 10 s: the second portion comes late, its rows
    count only in windows that are still open, and closed windows leave the state."""
    rows = with_instant(load(spark, d, "events").select("ts", "value", "event_type"), "ts").select(
        "ts", F.rint(F.col("value") * 100).cast("long").alias("cents"), "event_type")

    def counted(s):
        return s.withWatermark("ts", "10 seconds").groupBy(F.window("ts", "10 seconds", "2 seconds").alias("w")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select(
            F.unix_seconds("w.start").alias("window_second"), "n", "cents")

    work = two_portions(
        spark, rows, F.col("event_type") == "view", lambda s, w: update_table(counted(s), f"{w}/table", f"{w}/checkpoint"))
    return latest_per_key(spark.read.parquet(f"{work}/table"), ["window_second"], ["batch_no"]).drop("batch_no")


@query("progress_metrics", "SELECT count(*) AS rows_seen FROM events")
def progress_metrics(spark, d) -> DataFrame:
    """Progress reports of a run as typed rows: the rows each batch took in, added up."""
    reports = []

    def run(stream, w):
        q = sinks.start(stream, "parquet", f"{w}/checkpoint", path=f"{w}/table")
        q.awaitTermination()
        reports.extend(p.json for p in q.recentProgress)
        return q

    two_portions(spark, load(spark, d, "events"), F.col("event_type") == "view", run)
    return latency.progress_rows(spark, reports).agg(F.sum("numInputRows").alias("rows_seen"))
