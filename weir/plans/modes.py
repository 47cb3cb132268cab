"""Output modes, triggers and sinks side by side, real latencies, loads that overwrite, inferred XML and made ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from weir.operators import writes
from weir.registry import query
from weir.session import pinned, shared_dir
from weir.sources import xml as xml_source
from weir.streaming import latency, sinks
from weir.streaming.tables import update_table
from weir.operators.latest import latest_rows
from weir.tables import load


@query("stream_output_modes", """
  SELECT mode, event_type, count(*) AS n FROM events, (SELECT unnest(['append', 'complete', 'update']) AS mode) GROUP BY ALL""")
def stream_output_modes(spark, d) -> DataFrame:
    """One source read by three flows at once, each with a checkpoint of its own: rows appended, the whole
    result kept in memory, and changed results stored.  A second portion lands while they run."""
    events = load(spark, d, "events").select("event_id", "event_type")
    work, table = shared_dir(spark, "modes"), f"modes_{uuid.uuid4().hex}"
    counts = lambda s: s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    read = lambda: spark.readStream.schema(events.schema).parquet(f"{work}/landing")
    often = sinks.trigger_options("processing_time")
    first = F.col("event_type") == "view"
    events.filter(first).write.parquet(f"{work}/landing")
    flows = [
        sinks.start(read(), "parquet", sinks.flow_checkpoint(work, "rows", "append"), trigger=often, path=f"{work}/rows"),
        sinks.to_memory(counts(read()), table, sinks.flow_checkpoint(work, "counts", "complete"), "complete", often),
        update_table(counts(read()), f"{work}/counts", sinks.flow_checkpoint(work, "counts", "update"))]
    flows[2].awaitTermination()
    try:
        for flow in flows[:2]:
            flow.processAllAvailable()
        events.filter(~first).write.mode("append").parquet(f"{work}/landing")
        for flow in flows[:2]:
            flow.processAllAvailable()
    finally:
        for flow in flows[:2]:
            flow.stop()
    # the drained flow goes on from its checkpoint
    update_table(counts(read()), f"{work}/counts", sinks.flow_checkpoint(work, "counts", "update")).awaitTermination()
    kept = pinned(spark.table(table), "complete")
    spark.catalog.dropTempView(table)
    parts = {
        "append": counts(spark.read.parquet(f"{work}/rows")), "complete": kept,
        "update": latest_rows(spark.read.parquet(f"{work}/counts"), ["event_type"], ["batch_no"])}
    out = None
    for mode, rows in parts.items():
        part = rows.select(F.lit(mode).alias("mode"), "event_type", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("stream_row_latency", """
  SELECT triggertype, count(*) AS rows, true AS none_before_source, true AS in_order
  FROM events, (SELECT unnest(['availablenow', 'processingtime0']) AS triggertype) GROUP BY 1""")
def stream_row_latency(spark, d) -> DataFrame:
    """The time every row took from where it landed to the sink, per trigger type: how many rows, whether
    none is negative, and whether the percentiles of all batches stand in order."""
    work = shared_dir(spark, "latency")
    events = load(spark, d, "events").select("event_id", F.current_timestamp().alias("timestamp"))
    events.write.parquet(f"{work}/landing")

    def stored(kind: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            tagged = latency.row_latency(latency.tag_for_latency(batch, kind, batch_id))
            tagged.write.mode("overwrite").parquet(f"{work}/{kind}/batch_no={batch_id}")
        return write

    out = None
    for kind, trigger in (("availablenow", sinks.trigger_options("available_now")),
                          ("processingtime0", sinks.trigger_options("processing_time"))):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{work}/landing")
        flow = sinks.to_batches(stream, stored(kind), sinks.flow_checkpoint(work, "latency", kind), trigger=trigger)
        if kind == "availablenow":
            flow.awaitTermination()
        else:
            flow.processAllAvailable()
            flow.stop()
        rows = spark.read.parquet(f"{work}/{kind}").select("triggertype", "batch_id", "latency")
        out = rows if out is None else out.unionByName(rows)
    out = pinned(out, "latencies")
    ordered = latency.latency_percentiles(out).groupBy("triggertype").agg(
        F.bool_and((F.col("p50_latency") <= F.col("p95_latency")) & (F.col("p95_latency") <= F.col("p99_latency"))).alias("in_order"))
    counted = out.groupBy("triggertype").agg(F.count(F.lit(1)).alias("rows"), (F.min("latency") >= 0).alias("none_before_source"))
    return counted.join(ordered, "triggertype").select("triggertype", "rows", "none_before_source", "in_order")


@query("csv_overwrite_load", "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def csv_overwrite_load(spark, d) -> DataFrame:
    """CSV files with a header, types inferred, loaded over an older table of another schema."""
    work, name = shared_dir(spark, "csv"), f"weir_loaded_{uuid.uuid4().hex}"
    customers = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    customers.write.option("header", True).csv(f"{work}/customers")
    writes.replace_table(customers.select("c_name").limit(3), name)
    writes.load_csv(spark, f"{work}/customers", name)
    rows = pinned(spark.table(name), "loaded")
    spark.sql(f"DROP TABLE {name}")
    return rows


@query("xml_inferred_columns", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def xml_inferred_columns(spark, d) -> DataFrame:
    """A column of XML texts made into columns of the schema that one of them shows."""
    rows = load(spark, d, "supplier").select(F.to_xml(F.struct("s_suppkey", "s_name", "s_acctbal"), {"rowTag": "supplier"}).alias("body"))
    return xml_source.parsed_like_first(pinned(rows, "xml_texts"), "body").select("body.*")


@query("generated_ids", """
  SELECT o_orderstatus, count(*) AS n, count(*) AS different_uuids, count(*) AS different_numbers FROM orders GROUP BY 1""")
def generated_ids(spark, d) -> DataFrame:
    """Rows that get a random and a growing id; stored once, as they would differ on every read."""
    rows = pinned(load(spark, d, "orders").select(
        "o_orderstatus", F.uuid().alias("uuid"), F.monotonically_increasing_id().alias("number")), "ids")
    return rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("uuid").alias("different_uuids"), F.countDistinct("number").alias("different_numbers"))
