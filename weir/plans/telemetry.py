"""Device readings: a reading is an event, its position follows from user and event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators import devices
from weir.operators.sampling import even_subsample, stride_sample, systematic_sample
from weir.operators.writes import write_clustered
from weir.registry import query
from weir.session import shared_dir
from weir.sources.devices import normalize_device_messages
from weir.streaming.monitor import alerts, monitor_batch
from weir.streaming.windows import sliding_stats
from weir.tables import load, spread, with_instant

LAT = "((user_id * 37 + event_id * 3) % 140 - 70)"
LON = "((event_id * 13) % 360 - 180)"
_READINGS = f"""(SELECT event_id, user_id AS client_id, ts AS timestamp, CAST({LAT} AS DOUBLE) AS latitude,
  CAST({LON} AS DOUBLE) AS longitude, value AS speed, CAST(event_id % 360 AS DOUBLE) AS heading, event_type FROM events)"""
_PLACED = "latitude <> 0 AND longitude <> 0"


def readings(spark, d) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id", F.col("user_id").alias("client_id"), F.col("ts").alias("timestamp"),
        F.expr(LAT).cast("double").alias("latitude"), F.expr(LON).cast("double").alias("longitude"),
        F.col("value").alias("speed"), (F.col("event_id") % 360).cast("double").alias("heading"), "event_type")


@query("device_latest_location", f"""
  SELECT client_id, timestamp, latitude, longitude, speed, heading FROM {_READINGS} WHERE {_PLACED}
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY timestamp DESC) = 1""")
def device_latest_location(spark, d) -> DataFrame:
    return devices.latest_location(readings(spark, d))


@query("device_latest_reading", f"""
  SELECT client_id, max(timestamp) AS last_reading, count(*) AS total_readings FROM {_READINGS} GROUP BY 1 ORDER BY 2 DESC""")
def device_latest_reading(spark, d) -> DataFrame:
    return readings(spark, d).groupBy("client_id").agg(
        F.max("timestamp").alias("last_reading"), F.count(F.lit(1)).alias("total_readings")).orderBy(F.desc("last_reading"))


@query("device_orientation_stats", f"""
  SELECT client_id, avg(heading) AS avg_heading, avg(latitude) AS avg_latitude,
         round(stddev(heading), 6) AS stddev_heading, count(*) AS reading_count FROM {_READINGS} GROUP BY 1""")
def device_orientation_stats(spark, d) -> DataFrame:
    return readings(spark, d).groupBy("client_id").agg(
        F.avg("heading").alias("avg_heading"), F.avg("latitude").alias("avg_latitude"),
        F.round(F.stddev("heading"), 6).alias("stddev_heading"), F.count(F.lit(1)).alias("reading_count"))


@query("device_trace", f"""
  SELECT client_id, timestamp, latitude, longitude, speed FROM {_READINGS} WHERE {_PLACED} ORDER BY client_id, timestamp""")
def device_trace(spark, d) -> DataFrame:
    return devices.trace(readings(spark, d)).select("client_id", "timestamp", "latitude", "longitude", "speed")


@query("trace_subsample", f"""
  SELECT client_id, bucket, event_id, timestamp, latitude, longitude FROM (
    SELECT *, CAST(ntile(20) OVER (PARTITION BY client_id ORDER BY timestamp, event_id) AS INTEGER) AS bucket
    FROM {_READINGS} WHERE {_PLACED})
  QUALIFY row_number() OVER (PARTITION BY client_id, bucket ORDER BY timestamp, event_id) = 1""")
def trace_subsample(spark, d) -> DataFrame:
    rows = devices.located(readings(spark, d)).select("client_id", "event_id", "timestamp", "latitude", "longitude")
    return even_subsample(rows, ["client_id"], ["timestamp", "event_id"], 20)


@query("client_stats", f"""
  SELECT client_id, count(*) AS event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    arg_max(latitude, timestamp) FILTER (WHERE {_PLACED}) AS last_lat, arg_max(longitude, timestamp) FILTER (WHERE {_PLACED}) AS last_lon,
    epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(timestamp)) < 21600000000 AS is_active
  FROM {_READINGS} GROUP BY client_id""")
def client_stats(spark, d) -> DataFrame:
    """Active means seen in the last six hours before the newest reading."""
    rows = readings(spark, d)
    newest = rows.agg(F.max(F.col("timestamp").cast("timestamp")).alias("m")).scalar()
    return devices.client_stats(rows, newest, active_seconds=21_600)


@query("table_status", f"""
  SELECT count(*) AS total_records, count(DISTINCT client_id) AS unique_clients,
    round(count(*) * 288 / CAST(1048576 AS DOUBLE), 2) AS size_mb, max(timestamp) AS latest_at,
    arg_max(client_id, timestamp) AS latest_client FROM {_READINGS}""")
def table_status(spark, d) -> DataFrame:
    return devices.table_status(readings(spark, d))


@query("stream_tail", f"""
  SELECT client_id, timestamp, latitude, longitude, heading FROM {_READINGS} WHERE {_PLACED}
  ORDER BY timestamp DESC, client_id DESC LIMIT 50""")
def stream_tail(spark, d) -> DataFrame:
    return devices.tail(readings(spark, d), 50).select("client_id", "timestamp", "latitude", "longitude", "heading")


def messages(spark, d) -> DataFrame:
    """Readings as nested JSON; errors carry no readable time, sign-ups no readable speed."""
    r = spread(readings(spark, d))
    at = F.when(F.col("event_type") == "error", "soon").otherwise(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    speed = F.when(F.col("event_type") == "signup", "NaN").otherwise(F.col("speed").cast("string"))
    body = F.struct(
        F.concat(F.lit("device-"), F.col("client_id")).alias("clientId"), at.alias("timestamp"),
        F.struct("latitude", "longitude", speed.alias("speed"), "heading").alias("location"),
        F.struct(F.col("speed").alias("x"), F.lit(0.5).alias("y")).alias("acceleration"))
    return r.select("event_id", F.to_json(body).alias("message"))


@query("sensor_normalize", f"""
  SELECT event_id, 'device-' || client_id AS client_id, epoch_us(timestamp) AS timestamp, latitude, longitude,
    CASE WHEN event_type <> 'signup' THEN speed END AS speed, heading, speed AS acceleration_x,
    CAST(0.5 AS DOUBLE) AS acceleration_y, CAST(NULL AS DOUBLE) AS rotation_alpha FROM {_READINGS} WHERE event_type <> 'error'""")
def sensor_normalize(spark, d) -> DataFrame:
    return normalize_device_messages(messages(spark, d), "message").select(
        "event_id", "client_id", "timestamp", "latitude", "longitude", "speed", "heading",
        "acceleration_x", "acceleration_y", "rotation_alpha")


@query("partitioned_scan", """
  SELECT event_id, user_id, value, CAST(ts AS DATE)::VARCHAR AS date FROM events
  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
def partitioned_scan(spark, d) -> DataFrame:
    """A table partitioned by day and ordered by device inside its files; reading a range of
    days opens those partitions only."""
    path = shared_dir(spark, "by_date")
    rows = load(spark, d, "events").select("event_id", "user_id", "value", "ts", F.to_date("ts").alias("date"))
    write_clustered(rows, path, "date", ["user_id", "ts"])
    days = spark.read.parquet(path).filter(F.col("date").between("2024-01-10", "2024-01-12"))
    return days.select("event_id", "user_id", "value", F.col("date").cast("string").alias("date"))


@query("systematic_sample", """
  SELECT c_custkey, row_num FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) AS row_num
  FROM customer) WHERE row_num % 10 = 0""")
def every_tenth_customer(spark, d) -> DataFrame:
    keys = load(spark, d, "customer").select("c_custkey")
    return systematic_sample(keys, F.col("c_custkey") % 10, ["c_custkey"], 10)


@query("stride_sample", """
  SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE (rn - 1) % greatest(1, c // 15) = 0""")
def spread_points(spark, d) -> DataFrame:
    return stride_sample(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 15)


_SENSORS = """(SELECT event_id, user_id AS city, ts, floor(value) / 8 AS temperature, CAST(event_id % 101 AS DOUBLE) AS humidity,
  value * 4 AS co2_level, CAST(user_id % 60 AS DOUBLE) AS pm25_level FROM events)"""


def sensors(spark, d) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id", F.col("user_id").alias("city"), "ts", (F.floor("value") / 8).alias("temperature"),
        (F.col("event_id") % 101).cast("double").alias("humidity"), (F.col("value") * 4).alias("co2_level"),
        (F.col("user_id") % 60).cast("double").alias("pm25_level"))


@query("sliding_window_stats", """
  WITH s AS (SELECT round(value * 100) AS value, to_timestamp(0)::TIMESTAMP + to_microseconds((epoch_us(ts) // 600000000 - i) * 600000000) AS window_start
    FROM events, range(6) r(i))
  SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, avg(value) AS avg_value,
    min(value) AS min_value, max(value) AS max_value FROM s GROUP BY 1""")
def sliding_window_stats(spark, d) -> DataFrame:
    """Over whole cents, whose sums are exact."""
    rows = with_instant(load(spark, d, "events"), "ts").withColumn("value", F.rint(F.col("value") * 100))
    return sliding_stats(rows, "ts", "value", "1 hour", "10 minutes")


@query("env_monitor", f"""
  WITH s AS (SELECT *, temperature > 25 AS hot FROM {_SENSORS}),
  w AS (SELECT *, count(*) FILTER (WHERE hot) OVER u AS c, coalesce(sum(temperature) FILTER (WHERE hot) OVER u, 0) AS t,
      last_value(CASE WHEN hot THEN temperature END IGNORE NULLS) OVER (PARTITION BY city ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
    FROM s WINDOW u AS (PARTITION BY city ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, city, (t + temperature) / (c + 1) AS avg_temp,
    CASE WHEN hot OR l IS NULL OR temperature = l THEN 'stable' WHEN temperature > l THEN 'rising' ELSE 'falling' END AS trend,
    CAST(c AS INTEGER) AS high_temp_count FROM w""")
def env_monitor(spark, d) -> DataFrame:
    watched = monitor_batch(sensors(spark, d), "city", "ts", "event_id")
    return watched.select(
        "event_id", "city", F.col("hourly_avg_temp").alias("avg_temp"),
        F.col("temperature_trend").alias("trend"), "high_temp_count")


@query("env_alerts", f"""
  SELECT event_id, (CASE WHEN temperature > 25 THEN 'T;' ELSE '' END) || (CASE WHEN humidity > 80 THEN 'High humidity alert: ' || humidity || ' %;' ELSE '' END)
    || (CASE WHEN co2_level > 1000 THEN 'C;' ELSE '' END) || (CASE WHEN pm25_level > 35 THEN 'High pm25_level alert: ' || pm25_level || ' µg/m³;' ELSE '' END) AS alerts
  FROM {_SENSORS}""")
def env_alerts(spark, d) -> DataFrame:
    """Computed temperatures and co2 levels print differently per engine, so they are cut from the texts here."""
    text = F.regexp_replace(alerts(), r"High temperature alert: [^;]*;", "T;")
    return sensors(spark, d).select("event_id", F.regexp_replace(text, r"High co2_level alert: [^;]*;", "C;").alias("alerts"))
