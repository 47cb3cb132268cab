"""Ride fares: a ride is an order line, its fare the price, its distance the quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import mean_amount
from weir.operators.quality import Rule, clean
from weir.registry import query
from weir.tables import load

HIGH_FARE = 5_000


def rides(spark, d) -> DataFrame:
    raw = load(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("pickup"), F.col("l_suppkey").alias("pickup_zip"),
        F.pmod("l_partkey", F.lit(100)).alias("dropoff_zip"),
        F.col("l_extendedprice").alias("fare_amount"), F.col("l_quantity").alias("trip_distance"))
    return clean(raw, [Rule("valid_distance", "trip_distance > 0", "drop")])


def flagged(spark, d) -> DataFrame:
    costly = F.col("fare_amount") > HIGH_FARE
    same_zone, short = F.col("pickup_zip") == F.col("dropoff_zip"), F.col("trip_distance") < 5
    return rides(spark, d).filter(costly & (same_zone | short)).select(
        F.date_trunc("week", "pickup").alias("week"), F.col("pickup_zip").alias("zip"), "fare_amount", "trip_distance")


def weekly(spark, d) -> DataFrame:
    return rides(spark, d).groupBy(F.date_trunc("week", "pickup").alias("week")).agg(
        mean_amount(F.col("fare_amount")).alias("avg_amount"), F.avg("trip_distance").alias("avg_distance"))


_FLAGGED = f"""SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week, l_suppkey AS zip,
  l_extendedprice AS fare_amount, l_quantity AS trip_distance FROM lineitem
  WHERE l_quantity > 0 AND ((l_suppkey = l_partkey % 100 AND l_extendedprice > {HIGH_FARE})
    OR (l_quantity < 5 AND l_extendedprice > {HIGH_FARE}))"""
_WEEKLY = """SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS avg_amount, avg(l_quantity) AS avg_distance,
  CAST((2 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS avg_2,
  CAST((2000 * CAST(sum(l_quantity) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000 AS dist_3
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1"""


@query("flagged_rides", _FLAGGED)
def flagged_rides(spark, d) -> DataFrame:
    return flagged(spark, d)


@query("taxi_weekly_stats", f"SELECT week, avg_amount, avg_distance FROM ({_WEEKLY}) ORDER BY week")
def weekly_stats(spark, d) -> DataFrame:
    return weekly(spark, d).orderBy("week")


@query("taxi_top_n", f"""
  SELECT f.week, avg_2 AS avg_amount, dist_3 AS avg_distance,
         fare_amount, trip_distance, zip
  FROM ({_FLAGGED}) f LEFT JOIN ({_WEEKLY}) w ON f.week = w.week
  ORDER BY fare_amount DESC, zip, trip_distance, f.week LIMIT 3""")
def top_rides(spark, d, n: int = 3) -> DataFrame:
    """The costliest flagged rides beside their week's averages.

    The left join keeps every ride and adds columns only (one row per week on the right), so
    the top rides are picked first and just their weeks are looked up.
    """
    order = [F.desc("fare_amount"), "zip", "trip_distance", "week"]
    top = flagged(spark, d).orderBy(*order).limit(n)
    both = top.join(weekly(spark, d), "week", "left")
    return both.select(
        "week", F.round("avg_amount", 2).alias("avg_amount"), F.round("avg_distance", 3).alias("avg_distance"),
        "fare_amount", "trip_distance", "zip").orderBy(*order).limit(n)
