"""Reports over device readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions.fixed_values import BYTES_PER_READING
from weir.operators.cdc import latest_per_key
from weir.operators.ordered import null_safe_left_join

HAS_PLACE = "latitude IS NOT NULL AND longitude IS NOT NULL AND latitude <> 0 AND longitude <> 0"


def located(readings: DataFrame) -> DataFrame:
    """Readings with a usable position (0 stands for 'no fix')."""
    return readings.filter(HAS_PLACE)


def latest_location(readings: DataFrame, key: str = "client_id") -> DataFrame:
    cols = [key, "timestamp", "latitude", "longitude", "speed", "heading"]
    return latest_per_key(located(readings).select(*cols), [key], ["timestamp"])


def client_stats(readings: DataFrame, as_of: Column, active_seconds: int = 300) -> DataFrame:
    """Per client: readings, first and last seen, last usable position, active or not.

    Counts and times go through one hash aggregate; the last position is fetched by one row per client.
    """
    stats = readings.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))
    places = latest_per_key(located(readings).select("client_id", "timestamp", "latitude", "longitude"), ["client_id"], ["timestamp"])
    both = null_safe_left_join(
        stats, places.select("client_id", F.col("latitude").alias("last_lat"), F.col("longitude").alias("last_lon")), ["client_id"])
    age = F.unix_micros(as_of) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return both.select(
        "client_id", "event_count", "first_seen", "last_seen", "last_lat", "last_lon",
        (age < active_seconds * 1_000_000).alias("is_active"))


def client_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"))


def table_status(readings: DataFrame) -> DataFrame:
    """Row count, device count, size estimate and the newest record; of several devices with it the
    greatest id.  The readings go through one hash aggregate per device, the rest works on its rows."""
    per = readings.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))
    return per.agg(
        F.sum("n").alias("total_records"), F.count("client_id").alias("unique_clients"),
        F.max(F.struct("last", "client_id")).alias("_last"),
    ).select(
        F.coalesce("total_records", F.lit(0)).alias("total_records"), "unique_clients",
        F.round(F.coalesce("total_records", F.lit(0)) * BYTES_PER_READING / (1024 * 1024), 2).alias("size_mb"),
        F.col("_last.last").alias("latest_at"), F.col("_last.client_id").alias("latest_client"))


def trace(readings: DataFrame, client_id=None) -> DataFrame:
    """The ordered positions of one device, or of all devices device by device."""
    rows = located(readings)
    if client_id is not None:
        rows = rows.filter(F.col("client_id") == client_id)
    return rows.orderBy("client_id", "timestamp")


def tail(readings: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` readings for a live table."""
    return located(readings).orderBy(F.desc("timestamp"), F.desc("client_id")).limit(n)
