"""Change feeds and upserts: a change is an event (key: user, sequence: event id, error: delete)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import cents
from weir.operators import cdc
from weir.operators import writes
from weir.operators.partitioned import PartitionedTable
from weir.operators.timeline import Timeline
from weir.registry import query
from weir.session import pinned, shared_dir
from weir.tables import load

KEY, SEQ, DELETE = ["user_id"], "event_id", "event_type = 'error'"


def feed(spark, d) -> DataFrame:
    return load(spark, d, "events").select("user_id", "event_id", "event_type", "value")


_LAST = "SELECT user_id, event_id, event_type, value FROM events {where} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("cdc_scd1", _LAST.format(where=""))
def scd1(spark, d) -> DataFrame:
    return cdc.scd1(feed(spark, d), KEY, SEQ)


@query("cdc_scd1_delete", f"SELECT user_id, event_type, value FROM ({_LAST.format(where='')}) WHERE event_type <> 'error'")
def scd1_delete(spark, d) -> DataFrame:
    return cdc.scd1(feed(spark, d), KEY, SEQ, DELETE, except_cols=[SEQ])


_SCD2 = """SELECT user_id, event_type, value, event_id AS "__START_AT", e AS "__END_AT" FROM (
    SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events)
  WHERE event_type <> 'error'"""


def versions(spark, d) -> DataFrame:
    return cdc.scd2(feed(spark, d), KEY, SEQ, DELETE, except_cols=[SEQ])


@query("cdc_scd2", _SCD2)
def scd2(spark, d) -> DataFrame:
    return versions(spark, d)


def middle(spark, d):
    """Versions are asked for as of the middle of the change log."""
    return load(spark, d, "events").agg((F.max("event_id") / 2).cast("long").alias("m")).scalar()


_MIDDLE = "(SELECT max(event_id) // 2 FROM events)"


@query("cdc_scd2_as_of", f"""SELECT * FROM ({_SCD2}) WHERE "__START_AT" <= {_MIDDLE} AND ("__END_AT" IS NULL OR "__END_AT" > {_MIDDLE})""")
def scd2_as_of(spark, d) -> DataFrame:
    return cdc.as_of(versions(spark, d), middle(spark, d))


@query("as_of_version", _LAST.format(where=f"WHERE event_id <= {_MIDDLE}"))
def as_of_version(spark, d) -> DataFrame:
    return cdc.as_of_version(feed(spark, d), KEY, SEQ, middle(spark, d))


# Orders seen twice: as first stored (before 1999), and as delivered later (from 1998 on, repriced).
_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]


def stored(spark, d) -> DataFrame:
    return load(spark, d, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1999-01-01'").select(*_COLS)


def delivered(spark, d) -> DataFrame:
    late = load(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'")
    return late.select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderstatus")


@query("upsert_merge", """
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderstatus FROM orders""")
def upsert_merge(spark, d) -> DataFrame:
    return cdc.upsert(stored(spark, d), delivered(spark, d), ["o_orderkey"])


@query("insert_if_absent", """
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderstatus FROM orders""")
def insert_if_absent(spark, d) -> DataFrame:
    return cdc.insert_if_absent(stored(spark, d), delivered(spark, d), ["o_orderkey"])


@query("conditional_update", """
  SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def conditional_update(spark, d) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return cdc.conditional_update(
        rows, "o_orderpriority IN ('1-URGENT', '2-HIGH')",
        {"o_custkey": "NULL", "o_totalprice": "o_totalprice * 2"}).drop("o_orderpriority")


@query("schema_evolution_union", """
  SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderstatus END AS o_orderstatus FROM orders""")
def schema_evolution_union(spark, d) -> DataFrame:
    orders, cut = load(spark, d, "orders"), "TIMESTAMP_NTZ '1998-01-01'"
    first = orders.filter(f"o_orderdate < {cut}").select("o_orderkey", "o_totalprice")
    second = orders.filter(f"o_orderdate >= {cut}").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return cdc.union_evolved(first, second)


@query("index_change_set", """
  WITH old AS (SELECT doc_id, text, lang FROM documents WHERE lang <> 'fr'),
  new AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '.' ELSE text END AS text, lang FROM documents WHERE lang <> 'es')
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
    CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change
  FROM old o FULL JOIN new n ON o.doc_id = n.doc_id
  WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text <> n.text""")
def index_change_set(spark, d) -> DataFrame:
    """The indexed texts lack French ones, hold Spanish ones no longer wanted, and old German ones."""
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    newer = F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    now = docs.filter("lang <> 'es'").withColumn("text", newer)
    return cdc.change_set(docs.filter("lang <> 'fr'"), now, ["doc_id"], ["text", "lang"])


@query("unprocessed_keys", """
  SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem l WHERE l_returnflag IN ('R', 'A') AND NOT EXISTS (
    SELECT 1 FROM (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01') x
    WHERE x.l_orderkey = l.l_orderkey AND x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey)""")
def unprocessed_keys(spark, d) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = load(spark, d, "lineitem")
    done = lines.filter("l_shipdate < TIMESTAMP_NTZ '1998-01-01'")
    failed = lines.filter(F.col("l_returnflag").isin("R", "A")).select(*keys, "l_returnflag")
    return cdc.unprocessed(failed, done, keys)


@query("incremental_agg", """
  SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1""")
def incremental_agg(spark, d) -> DataFrame:
    """Stored sums of the older orders, completed by partial sums of the newer ones."""
    orders, cut = load(spark, d, "orders"), F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1999-01-01'")
    partial = lambda rows: rows.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("o_totalprice"))).alias("cents"))
    return cdc.merge_partials([partial(orders.filter(cut)), partial(orders.filter(~cut))], ["o_custkey"], ["n", "cents"])


@query("dedup_events", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS day FROM events")
def dedup_events(spark, d) -> DataFrame:
    rows = load(spark, d, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    return rows.dropDuplicates()


def _own_table(spark, name: str) -> str:
    """A table name of this run; the table is dropped as soon as its rows are stored elsewhere."""
    return f"weir_{name}_{uuid.uuid4().hex}"


def _read_and_drop(spark, name: str) -> DataFrame:
    rows = pinned(spark.table(name), "table")
    spark.sql(f"DROP TABLE {name}")
    return rows


@query("table_overwrite_append", """
  SELECT c_custkey, c_name, CASE WHEN c_nationkey >= 12 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def table_overwrite_append(spark, d) -> DataFrame:
    """A catalog table written twice, the second time with another schema, then appended to with one
    more column, and scanned by name."""
    customers, name = load(spark, d, "customer"), _own_table(spark, "customers")
    writes.replace_table(customers.select("c_custkey"), name)
    writes.replace_table(customers.filter("c_nationkey < 12").select("c_custkey", "c_name"), name)
    writes.append_table(customers.filter("c_nationkey >= 12").select("c_custkey", "c_name", "c_mktsegment"), name)
    return _read_and_drop(spark, name)


@query("table_as_select", "SELECT o_orderkey, o_totalprice, o_totalprice > 100000 AS large FROM orders")
def table_as_select(spark, d) -> DataFrame:
    """CREATE TABLE AS SELECT with a derived column."""
    name = _own_table(spark, "orders")
    load(spark, d, "orders").createOrReplaceTempView("weir_orders")
    spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT o_orderkey, o_totalprice, o_totalprice > 100000 AS large FROM weir_orders")
    return _read_and_drop(spark, name)


@query("table_filled_once", "SELECT n_nationkey, n_name FROM nation")
def table_filled_once(spark, d) -> DataFrame:
    """A reference table loaded while it is empty, and left alone by the second load."""
    name, rows = _own_table(spark, "nations"), load(spark, d, "nation").select("n_nationkey", "n_name")
    writes.fill_if_empty(spark, name, rows)
    writes.fill_if_empty(spark, name, rows.withColumn("n_name", F.lit("again")))
    return _read_and_drop(spark, name)


@query("cdc_ties", "SELECT count(DISTINCT user_id) AS keys, CAST(0 AS BIGINT) AS different FROM events")
def cdc_ties(spark, d) -> DataFrame:
    """Changes of one day share a sequence number: current rows and open versions pick the same one."""
    feed_ = load(spark, d, "events").select("user_id", F.to_date("ts").cast("timestamp").alias("day"), "event_type", "value")
    current = cdc.scd1(feed_, ["user_id"], "day").withColumnsRenamed({"event_type": "t", "value": "v"})
    open_ = cdc.scd2(feed_, ["user_id"], "day").filter(F.col(cdc.END).isNull())
    both = current.join(open_, "user_id", "full_outer")
    same = F.col("t").eqNullSafe(F.col("event_type")) & F.col("v").eqNullSafe(F.col("value"))
    return both.agg(F.count(F.lit(1)).alias("keys"), F.count_if(~same).alias("different"))


COMMITS = ["2024-01-06", "2024-01-11", "2024-01-16", "2024-01-21", "2024-01-26", "2024-02-01"]
ASKED = "2024-01-18 12:00:00"


def timeline_of_users(spark, d) -> Timeline:
    """What each user did last, committed every five days; an error deletes the user."""
    rows = load(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    columns = ["user_id", "event_type", "value"]
    table = Timeline(shared_dir(spark, "timeline"), rows.select(*columns).schema, ["user_id"], every=2)
    before = "1970-01-01"
    for day in COMMITS:
        part = rows.filter((F.col("ts") >= F.lit(before).cast("timestamp")) & (F.col("ts") < F.lit(day).cast("timestamp")))
        table.commit(cdc.latest_per_key(part, ["user_id"], ["event_id"]).select(*columns), day, DELETE)
        before = day
    return table


_AS_OF_TIME = """SELECT user_id, event_type, value FROM (
    SELECT * FROM events WHERE ts < TIMESTAMP '{}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
  WHERE event_type <> 'error'"""


@query("as_of_timestamp", f"""
  SELECT 'at ' || '{ASKED}' AS asked, * FROM ({_AS_OF_TIME.format('2024-01-16')}) UNION ALL
  SELECT 'version 5', * FROM ({_AS_OF_TIME.format('2024-01-26')})""")
def as_of_timestamp(spark, d) -> DataFrame:
    """A table as of a time between two commits, and as of a version, from snapshots and later changes."""
    table = timeline_of_users(spark, d)
    by_time = table.read(spark, timestamp=ASKED).select(F.lit(f"at {ASKED}").alias("asked"), "*")
    return by_time.unionByName(table.read(spark, version=5).select(F.lit("version 5").alias("asked"), "*"))


@query("partition_rewrites", """
  SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1998 AND o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         CASE WHEN year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, year(o_orderdate) AS year
  FROM orders WHERE NOT (year(o_orderdate) = 1996 AND o_orderkey % 3 = 0) AND year(o_orderdate) <> 1995""")
def partition_rewrites(spark, d) -> DataFrame:
    """A stored table partitioned by year: upsert into one year, update in another, deletes in a third,
    and a fourth emptied; only these years' files are written again."""
    rows = load(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("long").alias("year"))
    table = PartitionedTable(spark, shared_dir(spark, "orders"), rows.schema, "year")
    table.create(rows)
    newer = rows.filter("year = 1998 AND o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    table.upsert(newer, ["o_orderkey"])
    table.update("year = 1997 AND o_orderpriority = '1-URGENT'", {"o_orderstatus": "'X'"})
    table.delete("year = 1996 AND o_orderkey % 3 = 0 OR year = 1995")
    return table.read().drop("o_orderpriority")
