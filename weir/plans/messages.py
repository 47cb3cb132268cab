"""Message-bus records and JSON: records are made from events, documents and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import mean_amount, total_amount
from weir.functions.records import drop_all_null_columns, snake_case_columns
from weir.operators.aggregates import totals_and_breakdown
from weir.registry import query
from weir.session import shared_dir
from weir.sources.envelope import circulars, envelope, sensor_results
from weir.streaming.sinks import payload, with_headers
from weir.tables import load, spread

_START_MS = 1_700_000_000_000


def circular_records(spark, d) -> DataFrame:
    """Documents as JSON circulars in message-bus records (a binary value, no ``format`` for English)."""
    docs = spread(load(spark, d, "documents"))
    body = F.struct(
        F.lit("urn:circular:1").alias("$schema"), F.concat(F.lit("E"), "doc_id").alias("eventId"),
        F.col("source").alias("submitter"), F.lit("web").alias("submittedHow"),
        F.concat(F.lit("Re: "), "source").alias("subject"), F.col("doc_id").alias("circularId"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("format"), F.col("text").alias("body"),
        (F.lit(_START_MS) + F.col("doc_id") * 1500).alias("createdOn"))
    return docs.select(
        F.lit("circulars").alias("topic"), F.col("doc_id").alias("offset"),
        F.timestamp_millis(F.lit(_START_MS)).alias("timestamp"), F.to_json(body).cast("binary").alias("value"))


@query("kafka_envelope_parse", f"""
  SELECT 'circulars' AS topic, doc_id AS "offset", 'urn:circular:1' AS schema_url, 'E' || doc_id AS event_id, source AS submitter,
    'web' AS submitted_how, 'Re: ' || source AS subject, CAST(doc_id AS INTEGER) AS circular_id,
    CASE WHEN lang <> 'en' THEN lang END AS format, text AS body, {_START_MS} + doc_id * 1500 AS created_on_epoch,
    make_timestamp(({_START_MS} + doc_id * 1500) * 1000) AS created_on FROM documents""")
def kafka_envelope_parse(spark, d) -> DataFrame:
    return circulars(envelope(circular_records(spark, d))).drop("timestamp")


@query("kafka_payload_json", """
  SELECT '{"product":' || l_partkey || ',"quantity":' || CAST(l_quantity AS INTEGER) || ',"franchise":' || l_suppkey || ',"flag":"' || l_returnflag || '"}' AS value
  FROM lineitem WHERE l_extendedprice > 25000""")
def kafka_payload_json(spark, d) -> DataFrame:
    """High-value sales as message payloads; the filter reaches the scan."""
    sales = load(spark, d, "lineitem").filter("l_extendedprice > 25000").select(
        F.col("l_partkey").alias("product"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_suppkey").alias("franchise"), F.col("l_returnflag").alias("flag"))
    return sales.select(payload("product", "quantity", "franchise", "flag"))


@query("kafka_header_filter", """
  SELECT user_id AS sensor_id, value AS temperature, CASE WHEN user_id % 2 = 0 THEN 'realtime' ELSE 'processingtime0' END AS triggertype,
    CAST(day(ts) AS INTEGER) AS batch_id, 250 AS latency, 'purchase' AS run_id FROM events WHERE event_type = 'purchase'""")
def kafka_header_filter(spark, d) -> DataFrame:
    """Sensor records tagged with headers; one run is read back and its latency taken."""
    e = load(spark, d, "events").withColumn("at", F.date_trunc("millisecond", F.col("ts").cast("timestamp")))
    tagged = with_headers(
        e, triggertype=F.when(F.col("user_id") % 2 == 0, "realtime").otherwise("processingtime0"),
        runId=F.col("event_type"), batchId=F.dayofmonth("ts"))
    body = F.struct(F.col("user_id").alias("sensor_id"), F.col("value").alias("temperature"), F.col("at").alias("timestamp"))
    records = tagged.select(
        F.to_json(body).cast("binary").alias("value"), "headers",
        (F.col("at") + F.expr("INTERVAL 250 MILLISECOND")).alias("timestamp"))
    found = sensor_results(records, "purchase", "sensor_id BIGINT, temperature DOUBLE, timestamp TIMESTAMP")
    return found.drop("timestamp").withColumn("latency", F.col("latency").cast("int"))


@query("nested_json_fields", """
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id AS job_id, event_type AS pipeline_id FROM events""")
def nested_json_fields(spark, d) -> DataFrame:
    """Fields of a parsed JSON column and of records nested three deep."""
    e = load(spark, d, "events").select(
        "event_id", F.from_json("props", "k INT").alias("data"),
        F.struct(F.struct(F.col("user_id").alias("job_id")).alias("job_info"),
                 F.struct(F.col("event_type").alias("pipeline_id")).alias("pipeline_info")).alias("query_source"))
    return e.select("event_id", "data.*", "query_source.job_info.job_id", "query_source.pipeline_info.pipeline_id")


BLOCK = 1_000      # customers per JSON document


def nested_customers(spark, d) -> str:
    """Customers as JSON documents ``{"customers": [...]}`` with a nested address, one per file.

    A document takes a block of consecutive keys, so its array is bounded.
    """
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    one = F.struct(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("loyalty_tier"),
        F.col("c_acctbal").alias("total_spent"),
        F.struct(F.col("n_name").alias("city"), F.col("c_nationkey").alias("postal_code")).alias("address"))
    docs = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.floor(F.col("c_custkey") / BLOCK).alias("block")).agg(
        F.collect_list(one).alias("customers"))
    path = shared_dir(spark, "customers")
    docs.select("customers").write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("nested_customers_tiers", """
  SELECT c_mktsegment AS loyalty_tier, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS avg_spent, round(sum(c_acctbal), 2) AS total_spent,
    count(DISTINCT n_name) AS cities FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def nested_customers_tiers(spark, d) -> DataFrame:
    one = "STRUCT<customer_id: BIGINT, name: STRING, loyalty_tier: STRING, total_spent: DOUBLE, address: STRUCT<city: STRING, postal_code: INT>>"
    docs = spark.read.schema(f"customers ARRAY<{one}>").option("multiLine", True).json(nested_customers(spark, d))
    rows = docs.select(F.explode("customers").alias("c")).select("c.*", "c.address.*").drop("address")
    return rows.groupBy("loyalty_tier").agg(
        F.count(F.lit(1)).alias("n"), mean_amount(F.col("total_spent")).alias("avg_spent"),
        total_amount(F.col("total_spent")).alias("total_spent"), F.countDistinct("city").alias("cities"))


@query("snake_case_schema", """
  SELECT c_custkey AS user_id, c_name AS user_name, c_nationkey AS home_nation, c_mktsegment AS home_segment FROM customer""")
def snake_case_schema(spark, d) -> DataFrame:
    raw = load(spark, d, "customer").select(
        F.col("c_custkey").alias("userId"), F.col("c_name").alias("userName"),
        F.array(F.struct(F.col("c_nationkey").alias("homeNation"), F.col("c_mktsegment").alias("homeSegment"))).alias("homes"))
    return snake_case_columns(raw).select("user_id", "user_name", F.inline("homes"))


@query("class_stats", """
  SELECT 'classified' AS table_name, 'ALL' AS lang, count(*) AS num_events FROM documents
  UNION ALL SELECT 'classified', lang, count(*) FROM documents GROUP BY lang""")
def class_stats(spark, d) -> DataFrame:
    return totals_and_breakdown(load(spark, d, "documents").select("lang"), "lang", "table_name", "classified")


@query("drop_all_null_columns", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer")
def without_empty_columns(spark, d) -> DataFrame:
    rows = load(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") < 0, F.col("c_name")).alias("nickname"), F.lit(None).cast("int").alias("fax"))
    return drop_all_null_columns(rows)
