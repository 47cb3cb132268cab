"""Streams whose tables must bear late changes, retractions, copies and broken rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import cents
from weir.operators.quality import Rule
from weir.plans import changes, rides
from weir.registry import ORACLES, query
from weir.session import shared_dir
from weir.streaming.checked import CheckedTable, stream_checked
from weir.streaming.history import VersionTable, stream_versions
from weir.streaming.pairs import bounded_join, first_of_copies, with_window_stats
from weir.streaming.revised import RevisedTotals, stream_revised
from weir.streaming.tables import append_new
from weir.tables import load, with_instant


def portions(spark, parts: list[DataFrame], run) -> str:
    """Land one portion after the other, with a run of the stream after each.  A folder name as second
    item of a pair lands a portion there (several sources)."""
    work = shared_dir(spark, "feed")
    for part in parts:
        part.write.mode("append").parquet(f"{work}/landing")
        run(spark.readStream.schema(part.schema).parquet(f"{work}/landing"), work).awaitTermination()
    return work


# versions

def late_feed(spark, d) -> list[DataFrame]:
    """Changes out of order: every third event first, then the rest from the last to the first half."""
    feed, m = changes.feed(spark, d), changes.middle(spark, d)
    third, early = F.col("event_id") % 3 == 0, F.col("event_id") <= m
    return [feed.filter(third), feed.filter(~third & ~early), feed.filter(~third & early)]


@query("stream_scd2", ORACLES["cdc_scd2"])
def stream_scd2(spark, d) -> DataFrame:
    """Versions of a change feed whose portions arrive out of order: late changes split what is written."""
    parts = late_feed(spark, d)
    work = portions(spark, parts, lambda s, w: stream_versions(
        s, VersionTable(f"{w}/table", parts[0].schema, changes.KEY, changes.SEQ, changes.DELETE), f"{w}/checkpoint"))
    table = VersionTable(f"{work}/table", parts[0].schema, changes.KEY, changes.SEQ, changes.DELETE)
    return table.read(spark).drop(changes.SEQ)


@query("stream_scd2_compacted", ORACLES["cdc_scd2"])
def stream_scd2_compacted(spark, d) -> DataFrame:
    """The same with the batches folded into one before the last portion comes."""
    parts = late_feed(spark, d)
    table = lambda w, name="table": VersionTable(f"{w}/{name}", parts[0].schema, changes.KEY, changes.SEQ, changes.DELETE)
    work = portions(spark, parts[:2], lambda s, w: stream_versions(s, table(w), f"{w}/checkpoint"))
    folded = table(work).compact(spark, f"{work}/folded")
    parts[2].write.mode("append").parquet(f"{work}/landing")
    stream_versions(spark.readStream.schema(parts[0].schema).parquet(f"{work}/landing"), folded, f"{work}/checkpoint").awaitTermination()
    return table(work, "folded").read(spark).drop(changes.SEQ)


# aggregates under inserts, updates and deletes

def order_changes(spark, d) -> list[DataFrame]:
    """All orders; then urgent ones dearer and pending ones with the next customer; then low ones gone."""
    orders = load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", cents(F.col("o_totalprice")).alias("cents"))
    named = ["o_orderkey", "seq", "gone", "o_custkey", "value"]
    whole = (F.col("cents") / 100_000).cast("long")
    first = orders.withColumns({"seq": F.lit(1), "gone": F.lit(False), "value": whole})
    moved = F.col("o_orderstatus") == "P"
    second = orders.filter(moved | (F.col("o_orderpriority") == "1-URGENT")).withColumns({
        "seq": F.lit(2), "gone": F.lit(False), "o_custkey": F.col("o_custkey") + moved.cast("long"),
        "value": whole + F.when(F.col("o_orderpriority") == "1-URGENT", 7).otherwise(0)})
    third = orders.filter("o_orderpriority = '5-LOW'").withColumns({"seq": F.lit(3), "gone": F.lit(True), "value": whole})
    return [p.select(*named) for p in (first, second, third)]


@query("stream_revised_totals", """
  WITH final AS (
    SELECT o_custkey + CAST(o_orderstatus = 'P' AS BIGINT) AS o_custkey,
           CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) / 100000) AS BIGINT) + CASE WHEN o_orderpriority = '1-URGENT' THEN 7 ELSE 0 END AS v
    FROM orders WHERE o_orderpriority <> '5-LOW')
  SELECT o_custkey, count(*) AS rows, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS greatest, count(DISTINCT v) AS different
  FROM final GROUP BY 1""")
def stream_revised_totals(spark, d) -> DataFrame:
    """Count, sum, least, greatest and number of different values per customer, kept through inserts,
    updates (of values and of groups) and deletes in three runs."""
    parts = order_changes(spark, d)
    table = lambda w: RevisedTotals(f"{w}/table", parts[0].schema, ["o_orderkey"], ["o_custkey"])
    work = portions(spark, parts, lambda s, w: stream_revised(s, table(w), f"{w}/checkpoint"))
    return table(work).read(spark)


# rules

RULES = [Rule("priced", "l_extendedprice > 5000", "drop"), Rule("not returned", "l_returnflag <> 'R'", "drop"),
         Rule("discounted", "l_discount > 0"), Rule("keyed", "l_orderkey IS NOT NULL", "fail")]


def checked_lines(spark, d) -> CheckedTable:
    lines = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_discount", "l_linestatus")
    table = lambda w: CheckedTable(f"{w}/table", RULES)
    open_ = F.col("l_linestatus") == "O"
    work = portions(spark, [lines.filter(open_), lines.filter(~open_)], lambda s, w: stream_checked(s, table(w), f"{w}/checkpoint"))
    return table(work)


_BAD = "(l_extendedprice <= 5000 OR l_returnflag = 'R')"


@query("stream_checked_rows", f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE NOT {_BAD}")
def stream_checked_rows(spark, d) -> DataFrame:
    """Rows of a stream that keep its rules."""
    return checked_lines(spark, d).kept(spark).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("stream_quarantine", f"""
  SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_extendedprice <= 5000 THEN 'priced' END, CASE WHEN l_returnflag = 'R' THEN 'not returned' END,
    CASE WHEN l_discount <= 0 THEN 'discounted' END) AS failed_rules FROM lineitem WHERE {_BAD}""")
def stream_quarantine(spark, d) -> DataFrame:
    """Rows of a stream that break a rule, with the names of those they break."""
    return checked_lines(spark, d).quarantined(spark).select(
        "l_orderkey", "l_linenumber", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("stream_rule_metrics", """
  SELECT 'priced' AS rule, 'drop' AS action, count(*) FILTER (l_extendedprice > 5000) AS passed, count(*) FILTER (l_extendedprice <= 5000) AS failed FROM lineitem
  UNION ALL SELECT 'not returned', 'drop', count(*) FILTER (l_returnflag <> 'R'), count(*) FILTER (l_returnflag = 'R') FROM lineitem
  UNION ALL SELECT 'discounted', 'log', count(*) FILTER (l_discount > 0), count(*) FILTER (l_discount <= 0) FROM lineitem
  UNION ALL SELECT 'keyed', 'fail', count(*), 0 FROM lineitem""")
def stream_rule_metrics(spark, d) -> DataFrame:
    """Passed and failed rows of a stream per rule, added up over its batches."""
    return checked_lines(spark, d).metrics(spark)


# joins of two streams

def two_sources(spark, left: list[DataFrame], right: list[DataFrame], run) -> str:
    """Land a portion of both sources, with a run after each pair."""
    work = shared_dir(spark, "sources")
    for a, b in zip(left, right):
        a.write.mode("append").parquet(f"{work}/left")
        b.write.mode("append").parquet(f"{work}/right")
        run(spark.readStream.schema(a.schema).parquet(f"{work}/left"),
            spark.readStream.schema(b.schema).parquet(f"{work}/right"), work).awaitTermination()
    return work


def halves(df: DataFrame, time: str, at: str) -> list[DataFrame]:
    early = F.col(time) < F.lit(at).cast("timestamp")
    return [df.filter(early), df.filter(~early)]


CUT = "1998-01-01"


@query("stream_rides_weekly", f"""
  WITH w AS ({rides._WEEKLY}), f AS ({rides._FLAGGED}),
  last AS (SELECT max(CAST(l_shipdate AS TIMESTAMP)) AS t FROM lineitem WHERE l_quantity > 0),
  flagged_last AS (SELECT max(CAST(l_shipdate AS TIMESTAMP)) AS t FROM lineitem
    WHERE l_quantity > 0 AND l_extendedprice > {rides.HIGH_FARE} AND (l_suppkey = l_partkey % 100 OR l_quantity < 5))
  SELECT f.week, f.zip, f.fare_amount, f.trip_distance, CAST(n AS BIGINT) AS rides, CAST(distance AS BIGINT) AS distance FROM f JOIN (
    SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week, count(*) AS n, sum(l_quantity) AS distance FROM lineitem WHERE l_quantity > 0 GROUP BY 1) s
    ON s.week = f.week, last, flagged_last
  WHERE f.week + INTERVAL 7 DAY <= least(last.t, flagged_last.t)""")
def stream_rides_weekly(spark, d) -> DataFrame:
    """Flagged rides beside their week's totals, both as streams: a week comes out when it is over."""
    every = with_instant(rides.rides(spark, d), "pickup").select("pickup", "trip_distance", "fare_amount", "pickup_zip", "dropoff_zip")
    costly = F.col("fare_amount") > rides.HIGH_FARE
    odd = (F.col("pickup_zip") == F.col("dropoff_zip")) | (F.col("trip_distance") < 5)
    flagged = every.filter(costly & odd).select("pickup", F.col("pickup_zip").alias("zip"), "fare_amount", "trip_distance")

    def run(left, right, w):
        joined = with_window_stats(
            left, right.select("pickup", F.col("trip_distance").alias("d")), "pickup", "7 days", "4 days", "0 seconds",
            rides=F.count(F.lit(1)), distance=F.sum("d").cast("long"))
        return append_new_later(joined.select(
            F.col("window.start").alias("week"), "zip", "fare_amount", "trip_distance", "rides", "distance"), w)

    work = two_sources(spark, halves(flagged, "pickup", CUT), halves(every, "pickup", CUT), run)
    return spark.read.parquet(f"{work}/table").withColumn("week", F.col("week").cast("timestamp_ntz"))


def append_new_later(stream: DataFrame, work: str):
    from weir.streaming.sinks import start

    return start(stream, "parquet", f"{work}/checkpoint", path=f"{work}/table")


@query("stream_order_returns", """
  WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS shipped FROM lineitem WHERE l_returnflag = 'R'),
  o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ordered FROM orders),
  mark AS (SELECT least((SELECT max(ordered) FROM o), (SELECT max(shipped) FROM r)) AS t)
  SELECT o_orderkey, l_linenumber FROM o JOIN r ON o_orderkey = l_orderkey AND shipped >= ordered AND shipped <= ordered + INTERVAL 60 DAY
  UNION ALL
  SELECT o_orderkey, NULL FROM o, mark WHERE ordered + INTERVAL 60 DAY < mark.t AND NOT EXISTS (
    SELECT 1 FROM r WHERE o_orderkey = l_orderkey AND shipped >= ordered AND shipped <= ordered + INTERVAL 60 DAY)""")
def stream_order_returns(spark, d) -> DataFrame:
    """Orders with their returned lines shipped within 60 days, both as streams; an order without any
    comes out when none can come any more."""
    orders = with_instant(load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ordered")), "ordered")
    lines = with_instant(load(spark, d, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_shipdate").alias("shipped")), "shipped")

    def run(left, right, w):
        joined = bounded_join(left, right, ["o_orderkey"], "ordered", "shipped", "60 DAYS", "0 seconds")
        return append_new_later(joined.select("o_orderkey", "l_linenumber"), w)

    work = two_sources(spark, halves(orders, "ordered", CUT), halves(lines, "shipped", CUT), run)
    return spark.read.parquet(f"{work}/table")


# copies

@query("stream_first_of_copies", "SELECT event_id, user_id, event_type, value FROM events")
def stream_first_of_copies(spark, d) -> DataFrame:
    """Events delivered again: the second portion brings the last days of the first once more, and some
    events twice.  Each is taken once."""
    events = with_instant(load(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts"), "ts")
    first, second = halves(events, "ts", "2024-01-16")
    again = first.filter(F.col("ts") >= F.lit("2024-01-12").cast("timestamp"))
    work = portions(
        spark, [first, second.unionByName(again).unionByName(second.filter(F.col("event_id") % 5 == 0))],
        lambda s, w: append_new_later(first_of_copies(s, ["event_id"], "ts", "10 days"), w))
    return spark.read.parquet(f"{work}/table").drop("ts")
