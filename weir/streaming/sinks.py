"""Writing streams: message payloads, headers, triggers, memory and console sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.functions.records import header_array


def payload(*cols: str) -> Column:
    """The named columns as one JSON message value."""
    return F.to_json(F.struct(*cols)).alias("value")


def with_headers(df: DataFrame, **values: Column) -> DataFrame:
    return df.withColumn("headers", header_array(values))


def trigger_options(kind: str, interval: str = "0 seconds") -> dict:
    """``available_now`` drains and stops, ``processing_time`` repeats at an interval."""
    if kind == "available_now":
        return {"availableNow": True}
    if kind == "processing_time":
        return {"processingTime": interval}
    raise ValueError(f"unknown trigger {kind!r}")


def flow_checkpoint(folder: str, flow: str, mode: str) -> str:
    """The checkpoint of one flow in one mode, so that no two queries share state."""
    return f"{folder}/checkpoints/{flow}/{mode}"


def start(
    stream: DataFrame, fmt: str, checkpoint: str, mode: str = "append", trigger: dict | None = None,
    name: str | None = None, **options: str,
) -> StreamingQuery:
    """Start one flow; every flow has a checkpoint of its own."""
    writer = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.options(**options).trigger(**(trigger or trigger_options("available_now")))
    return (writer.queryName(name) if name else writer).start()


def to_bus(stream: DataFrame, servers: str, topic: str, checkpoint: str, **options) -> StreamingQuery:
    """Send ``value`` (and ``headers``) rows to a topic; the kafka connector must be installed."""
    return start(
        stream, "kafka", checkpoint, "append", options.pop("trigger", None), options.pop("name", None),
        **{"kafka.bootstrap.servers": servers, "topic": topic, **options})


def to_memory(stream: DataFrame, name: str, checkpoint: str, mode="update", trigger=None) -> StreamingQuery:
    return start(stream, "memory", checkpoint, mode, trigger, name)


def to_console(stream: DataFrame, checkpoint: str, mode="update", trigger=None) -> StreamingQuery:
    return start(stream, "console", checkpoint, mode, trigger)


def to_batches(stream: DataFrame, write, checkpoint: str, mode="append", trigger=None, name=None) -> StreamingQuery:
    """Call ``write(batch, batch_id)`` per micro-batch.  A batch may come again after a
    failure, so ``write`` must give the same result when repeated."""
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or trigger_options("available_now")))
    return (writer.queryName(name) if name else writer).start()
