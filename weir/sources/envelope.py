"""Message-bus records: reading them, their envelope, and JSON documents inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.functions.records import has_header, header_value, json_fields

CIRCULAR_FIELDS = {
    "schema_url": ("$['$schema']", "string"),
    "event_id": ("$.eventId", "string"),
    "submitter": ("$.submitter", "string"),
    "submitted_how": ("$.submittedHow", "string"),
    "subject": ("$.subject", "string"),
    "circular_id": ("$.circularId", "int"),
    "format": ("$.format", "string"),
    "body": ("$.body", "string"),
    "created_on_epoch": ("$.createdOn", "bigint"),
}


def bus_stream(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Stream of a topic from its earliest offset (the kafka connector must be installed).

    Security settings such as ``kafka.sasl.mechanism`` go into ``options``.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", topics).options(**{"startingOffsets": "earliest", **options}).load()


def bus_batch(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """All records of a topic between two offsets, with their headers."""
    bounds = {"startingOffsets": "earliest", "endingOffsets": "latest", "includeHeaders": "true"}
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", topics).options(**{**bounds, **options}).load()


def envelope(records: DataFrame) -> DataFrame:
    """Topic, offset, timestamp, the value as text, and headers if the records carry them."""
    extra = ["headers"] if "headers" in records.columns else []
    return records.select("topic", "offset", "timestamp", F.col("value").cast("string").alias("msg"), *extra)


def circulars(messages: DataFrame) -> DataFrame:
    """Typed columns of JSON circulars."""
    typed = json_fields(messages, "msg", CIRCULAR_FIELDS)
    return typed.withColumn("created_on", F.timestamp_millis("created_on_epoch")).drop("msg")


def sensor_results(records: DataFrame, run_id: str, schema: str) -> DataFrame:
    """Sensor rows of one run with trigger type, batch and latency, read from message headers."""
    mine = records.filter(has_header("headers", "runId", F.lit(run_id)))
    rows = mine.select(
        F.from_json(F.col("value").cast("string"), schema).alias("data"),
        header_value("headers", "triggertype").alias("triggertype"),
        header_value("headers", "batchId").cast("int").alias("batch_id"),
        F.unix_millis("timestamp").alias("_sink"))
    late = F.col("_sink") - F.unix_millis("data.timestamp")
    return rows.select("data.*", "triggertype", "batch_id", late.alias("latency"), F.lit(run_id).alias("run_id"))
