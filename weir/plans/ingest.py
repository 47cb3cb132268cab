"""Round trips through files: tables are exported to the shared folder and ingested again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from weir.plans.flights import _PARSED, PARSED_COLUMNS, vectors_of_events
from weir.operators.writes import read_evolved
from weir.registry import query
from weir.session import shared_dir
from weir.sources import xml as xml_source
from weir.sources.files import export_files, incremental_files
from weir.sources.state_vectors import read_state_vectors
from weir.streaming.tables import append_new
from weir.tables import load


def _flat_orders(spark, d) -> DataFrame:
    return load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


_FLAT = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


def _two_runs(spark, d, fmt: str, **options: str) -> DataFrame:
    """Files land twice; each run on the same checkpoint takes in the new files only."""
    work, orders = shared_dir(spark, f"ingest_{fmt}"), _flat_orders(spark, d)
    files = max(2, spark.sparkContext.defaultParallelism)
    for landed in (F.col("o_orderstatus") == "P", F.col("o_orderstatus") != "P"):
        export_files(orders.filter(landed), f"{work}/landing", fmt, files, **options)
        stream = incremental_files(
            spark, f"{work}/landing", fmt, schema_location=f"{work}/schema",
            options={**options, **({"inferSchema": "true"} if fmt == "csv" else {})})
        append_new(stream, f"{work}/table", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/table").withColumn("day", F.col("day").cast("string"))


@query("ingest_json_incremental", _FLAT)
def ingest_json(spark, d) -> DataFrame:
    return _two_runs(spark, d, "json")


@query("ingest_csv_incremental", _FLAT)
def ingest_csv(spark, d) -> DataFrame:
    return _two_runs(spark, d, "csv", header="true")


DOCUMENTS_PER_FILE = 500        # suppliers, numbered without gaps, in one pretty-printed array


@query("ingest_json_multiline", "SELECT s_suppkey, s_name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ingest_multiline(spark, d) -> DataFrame:
    """Pretty-printed JSON arrays of many documents a file, read through a glob."""
    work = shared_dir(spark, "multiline")
    s, n = load(spark, d, "supplier"), load(spark, d, "nation")
    doc = F.struct("s_suppkey", "s_name", F.col("n_name").alias("nation"))
    block = (F.col("s_suppkey") / DOCUMENTS_PER_FILE).cast("long").alias("block")
    files = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(block).agg(
        F.to_json(F.collect_list(doc), {"pretty": "true"}).alias("value"))
    files.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(f"{work}/landing")
    stream = incremental_files(
        spark, f"{work}/landing/*.txt", "json", "s_suppkey BIGINT, s_name STRING, nation STRING", options={"multiLine": "true"})
    append_new(stream, f"{work}/table", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/table")


@query("xml_rows", """
  SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, 'N' || s_nationkey || ',R' || s_nationkey % 5 AS places, s_name AS parsed_name FROM supplier""")
def xml_rows(spark, d) -> DataFrame:
    """Rows from elements: an attribute, text elements, a repeated element; one column is made
    XML again and parsed back."""
    work = shared_dir(spark, "xml")
    place = F.array(F.concat(F.lit("N"), "s_nationkey"), F.concat(F.lit("R"), F.col("s_nationkey") % 5))
    rows = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), place.alias("place"))
    xml_source.write_xml(rows, work, "supplier", "suppliers")
    back = xml_source.xml_rows(spark, work, "supplier", "_id BIGINT, name STRING, balance DOUBLE, place ARRAY<STRING>")
    text = F.to_xml(F.struct("name"))
    return back.select(
        F.col("_id").alias("id"), "name", "balance", F.array_join("place", ",").alias("places"),
        F.from_xml(text, "name STRING")["name"].alias("parsed_name"))


@query("xml_stream_evolution", """
  SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 4000 THEN s_acctbal END AS balance FROM supplier""")
def xml_stream_evolution(spark, d) -> DataFrame:
    """XML files taken in by two runs; the second portion has an element the stored schema gains."""
    work, s = shared_dir(spark, "xml_stream"), load(spark, d, "supplier")
    rich = F.col("s_acctbal") > 4000
    old = s.filter(~rich).select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"))
    new = s.filter(rich).select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    for n, part in enumerate((old, new)):
        xml_source.write_xml(part, f"{work}/landing/run{n}", "supplier", "suppliers")
        stream = incremental_files(
            spark, f"{work}/landing/*", "xml", schema_location=f"{work}/schema", options={"rowTag": "supplier"}, evolve=True)
        append_new(stream, f"{work}/table", f"{work}/checkpoint")
    return read_evolved(spark, f"{work}/table").select(F.col("_id").alias("id"), "name", "balance")


_XSD = """<?xml version="1.0"?><xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="customer"><xs:complexType>
<xs:sequence><xs:element name="name" type="xs:string"/><xs:element name="balance" type="xs:decimal"/></xs:sequence>
<xs:attribute name="id" type="xs:long" use="required"/></xs:complexType></xs:element></xs:schema>"""


def put_text(spark, text: str, name: str) -> str:
    """Write a small text to one file in the shared folder; its path."""
    folder = shared_dir(spark, name)
    spark.createDataFrame([(text.replace("\n", " "),)], "value STRING").coalesce(1).write.text(folder)
    return spark.read.text(folder).inputFiles()[0]


@query("xml_validated_split", """
  SELECT c_custkey, c_mktsegment <> 'MACHINERY' AS is_valid FROM customer""")
def xml_validated_split(spark, d) -> DataFrame:
    """Elements checked against an XSD; the text of those that fail is kept."""
    work = shared_dir(spark, "xml_checked")
    balance = F.when(F.col("c_mktsegment") == "MACHINERY", "unknown").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), balance.alias("balance"))
    xml_source.write_xml(rows, work, "customer", "customers")
    read = xml_source.xml_rows(
        spark, work, "customer", f"_id BIGINT, name STRING, balance DOUBLE, {xml_source.CORRUPT} STRING", put_text(spark, _XSD, "xsd"))
    good, bad = xml_source.split_valid(read)
    number = F.regexp_extract(xml_source.CORRUPT, 'id="([0-9]+)"', 1).cast("long")
    return good.select(F.col("_id").alias("c_custkey"), F.lit(True).alias("is_valid")).unionAll(
        bad.select(number.alias("c_custkey"), F.lit(False).alias("is_valid")))


@query("state_vector_source", _PARSED)
def state_vector_source(spark, d) -> DataFrame:
    """Snapshot files of positional arrays, read through the registered data source."""
    path = shared_dir(spark, "snapshots")
    vectors_of_events(spark, d).select(
        F.to_json(F.struct("time", F.array("state").alias("states")), {"ignoreNullFields": "false"})).write.text(path)
    return read_state_vectors(spark, path, "GLOBAL").select(*PARSED_COLUMNS)


@query("state_vector_stream", _PARSED)
def state_vector_stream(spark, d) -> DataFrame:
    """The same as a stream: two portions land, the second under names that sort before the first,
    and two runs on one checkpoint take in every snapshot once."""
    work = shared_dir(spark, "snapshot_stream")
    vectors = vectors_of_events(spark, d).select(
        F.to_json(F.struct("time", F.array("state").alias("states")), {"ignoreNullFields": "false"}).alias("value"))
    for folder, part in (("b", F.xxhash64("value") % 2 == 0), ("a", F.xxhash64("value") % 2 != 0)):
        vectors.filter(part).write.text(f"{work}/landing/{folder}")
        stream = read_state_vectors(spark, f"{work}/landing", "GLOBAL", stream=True, manifest=f"{work}/taken")
        append_new(stream, f"{work}/table", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/table").select(*PARSED_COLUMNS)


@query("xml_rescued", """
  SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 4000 THEN '{"balance":"' || CAST(s_acctbal AS DECIMAL(12,2)) || '"}' END AS rescued FROM supplier""")
def xml_rescued(spark, d) -> DataFrame:
    """Elements that the expected columns do not name are kept as JSON."""
    work, s = shared_dir(spark, "xml_rescued"), load(spark, d, "supplier")
    balance = F.when(F.col("s_acctbal") > 4000, F.col("s_acctbal").cast("decimal(12,2)").cast("string"))
    xml_source.write_xml(s.select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), balance.alias("balance")), work, "supplier", "suppliers")
    read = xml_source.xml_rows(spark, work, "supplier", "_id BIGINT, name STRING, balance STRING")
    return xml_source.rescue_unmatched(read, T.StructType.fromDDL("_id BIGINT, name STRING"), "rescued").withColumnRenamed("_id", "id")


@query("xml_sql_table", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey < 10")
def xml_sql_table(spark, d) -> DataFrame:
    """SQL straight over XML files."""
    work = shared_dir(spark, "xml_table")
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    xml_source.write_xml(rows, work, "supplier", "suppliers")
    xml_source.xml_view(spark, "weir_suppliers_xml", work, "supplier")
    return spark.sql("SELECT _id AS id, name FROM weir_suppliers_xml WHERE nation < 10")


@query("stream_table_passthrough", "SELECT event_id, user_id, event_type, value FROM events")
def stream_table_passthrough(spark, d) -> DataFrame:
    """A table read as a stream: two appends, two runs on one checkpoint, every row once."""
    work = shared_dir(spark, "passthrough")
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for part in (F.col("event_type") == "view", F.col("event_type") != "view"):
        rows.filter(part).write.mode("append").parquet(f"{work}/source")
        stream = spark.readStream.schema(rows.schema).parquet(f"{work}/source")
        append_new(stream, f"{work}/table", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/table")
