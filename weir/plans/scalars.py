"""Scalar functions in use, on customers, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.registry import query
from weir.tables import load, with_instant


@query("fn_string", """
  SELECT c_custkey, concat_ws('|', c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS skips_null,
    c_name || CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS keeps_null, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded,
    left(c_name, 4) AS head, right(c_name, 3) AS tail, substring(c_name, 3, 5) AS middle, lower(trim('  ' || c_mktsegment || ' ')) AS low,
    CAST(length(c_name) AS INTEGER) AS len, replace(c_name, '#', '-') AS swapped, split_part(c_name, '#', 2) AS part,
    CAST(strpos(c_name, '#') AS INTEGER) AS at, md5(c_name) AS digest FROM customer""")
def strings(spark, d) -> DataFrame:
    seg = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return load(spark, d, "customer").select(
        "c_custkey", F.concat_ws("|", "c_name", seg).alias("skips_null"), F.concat("c_name", seg).alias("keeps_null"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.left("c_name", F.lit(4)).alias("head"),
        F.right("c_name", F.lit(3)).alias("tail"), F.substring("c_name", 3, 5).alias("middle"),
        F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("low"), F.length("c_name").alias("len"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("swapped"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part"),
        F.instr("c_name", "#").alias("at"), F.md5("c_name").alias("digest"))


@query("fn_date", """
  SELECT event_id, CAST(ts AS DATE)::VARCHAR AS day, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start, CAST(year(ts) AS INTEGER) AS y,
    CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m, CAST(hour(ts) AS INTEGER) AS h, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow,
    strftime(ts, '%A') AS dow_name, epoch_us(ts) // 1000 AS millis, make_timestamp(epoch_us(ts) // 1000 * 1000) AS back,
    (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 1000000 AS secs_left, ts - to_days(CAST(event_id % 90 AS INTEGER)) AS earlier,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def dates(spark, d) -> DataFrame:
    e = load(spark, d, "events")
    at = F.col("ts")
    instant = at.cast("timestamp")
    return e.select(
        "event_id", F.to_date(at).cast("string").alias("day"), F.date_trunc("month", at).alias("month_start"),
        F.year(at).alias("y"), F.quarter(at).alias("q"), F.month(at).alias("m"), F.hour(at).alias("h"),
        F.dayofweek(at).alias("dow"), F.date_format(at, "EEEE").alias("dow_name"), F.unix_millis(instant).alias("millis"),
        F.timestamp_millis(F.unix_millis(instant)).alias("back"),
        F.timestamp_diff("SECOND", at, F.lit("2024-02-01").cast("timestamp_ntz")).alias("secs_left"),
        (at - F.make_interval(days=(F.col("event_id") % 90).cast("int"))).alias("earlier"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("fn_math", """
  SELECT event_id, round(value * 2, 1) AS r, abs(value - 100) AS a, event_id % 7 AS rest, CAST(floor(value) AS BIGINT) AS f,
    least(value, 50.0::DOUBLE) AS lo, round(sin(value), 6) AS s, round(cos(radians(value)), 6) AS c, round(sqrt(value), 6) AS q,
    round(degrees(value), 6) AS g, greatest(-85.0::DOUBLE, least(85.0::DOUBLE, value)) AS clamped FROM events""")
def numbers(spark, d) -> DataFrame:
    v = F.col("value")
    return load(spark, d, "events").select(
        "event_id", F.round(v * 2, 1).alias("r"), F.abs(v - 100).alias("a"), (F.col("event_id") % 7).alias("rest"),
        F.floor(v).alias("f"), F.least(v, F.lit(50.0)).alias("lo"), F.round(F.sin(v), 6).alias("s"),
        F.round(F.cos(F.radians(v)), 6).alias("c"), F.round(F.sqrt(v), 6).alias("q"), F.round(F.degrees(v), 6).alias("g"),
        F.greatest(F.lit(-85.0), F.least(F.lit(85.0), v)).alias("clamped"))


@query("fn_collection", """
  SELECT o_orderkey, ['a', 'b', 'c'][o_orderkey % 3 + 1] AS picked, CAST(len(string_split(o_orderpriority, '-')) AS INTEGER) AS n,
    word, len([x FOR x IN [o_orderkey % 5, o_orderkey % 4] IF x > 2]) > 0 AS any_big FROM orders, unnest(string_split(o_orderpriority, '-')) AS t(word)""")
def collections(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    letters = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    parts = F.split("o_orderpriority", "-")
    return load(spark, d, "orders").select(
        "o_orderkey", F.element_at(letters, (key % 3 + 1).cast("int")).alias("picked"), F.size(parts).alias("n"),
        F.explode(parts).alias("word"), F.exists(F.array(key % 5, key % 4), lambda x: x > 2).alias("any_big"))
