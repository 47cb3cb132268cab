"""Aircraft positions: a state vector is an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.fixed_values import COUNTRY_CENTROIDS
from weir.operators import geo
from weir.plans.telemetry import LAT, LON
from weir.registry import query
from weir.sources.state_vectors import parse_state_vectors
from weir.tables import load, spread

HOMES = [c for c, _, _ in COUNTRY_CENTROIDS]
_GEO_ALT = "CASE WHEN event_type <> 'click' THEN value * 20 END"
_BARO_ALT = "CASE WHEN event_type <> 'view' THEN value * 19 END"
_FLIGHTS = f"""(SELECT event_id, user_id, ts, CAST({LAT} AS DOUBLE) AS latitude, CAST({LON} AS DOUBLE) AS longitude,
  value AS velocity, CAST(event_id % 360 AS DOUBLE) AS heading, event_type = 'signup' AS on_ground,
  coalesce({_GEO_ALT}, {_BARO_ALT}, 0) AS altitude, CAST(event_id % 21 - 10 AS DOUBLE) AS vertical_rate,
  ['{"','".join(HOMES)}'][user_id % 80 + 1] AS origin_country FROM events)"""


def flights(spark, d) -> DataFrame:
    names = F.array(*[F.lit(c) for c in HOMES])
    return load(spark, d, "events").select(
        "event_id", "user_id", "ts", F.expr(LAT).cast("double").alias("latitude"),
        F.expr(LON).cast("double").alias("longitude"), F.col("value").alias("velocity"),
        (F.col("event_id") % 360).cast("double").alias("heading"), (F.col("event_type") == "signup").alias("on_ground"),
        F.expr(_GEO_ALT).alias("geo_altitude"), F.expr(_BARO_ALT).alias("baro_altitude"),
        (F.col("event_id") % 21 - 10).cast("double").alias("vertical_rate"),
        F.get(names, (F.col("user_id") % 80).cast("int")).alias("origin_country"),
    ).withColumn("altitude", geo.altitude())


@query("flights_stats", f"""
  SELECT count(*) AS num_events, count(DISTINCT user_id) AS unique_aircraft, max(vertical_rate) AS max_asc_rate,
    min(vertical_rate) AS max_desc_rate, max(velocity) AS max_speed, max(altitude) AS max_altitude,
    (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS observation_duration FROM {_FLIGHTS}""")
def flights_stats(spark, d) -> DataFrame:
    return flights(spark, d).agg(
        F.count(F.lit(1)).alias("num_events"), F.countDistinct("user_id").alias("unique_aircraft"),
        F.max("vertical_rate").alias("max_asc_rate"), F.min("vertical_rate").alias("max_desc_rate"),
        F.max("velocity").alias("max_speed"), F.max("altitude").alias("max_altitude"),
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("observation_duration"))


_BOXES = "(VALUES " + ", ".join(
    f"('{r}', {s}, {n}, {w}, {e})" for r, (s, n, w, e) in geo.REGION_BOXES.items()) + ") AS b(region, s, n, w, e)"


@query("geo_region_filter", f"""
  SELECT event_id, region FROM {_FLIGHTS} JOIN {_BOXES} ON latitude BETWEEN s AND n AND longitude BETWEEN w AND e""")
def geo_region_filter(spark, d) -> DataFrame:
    return geo.with_regions(flights(spark, d).select("event_id", "latitude", "longitude")).select("event_id", "region")


@query("geo_stats", f"""
  SELECT on_ground, count(*) AS n, round(avg(altitude) * CAST(3.28084 AS DOUBLE), 2) AS mean_altitude_ft,
    round(max(velocity) * CAST(1.94384 AS DOUBLE), 2) AS max_speed_kt, count(DISTINCT origin_country) AS countries,
    count(*) FILTER (WHERE NOT on_ground AND velocity > 10) AS airborne FROM {_FLIGHTS} GROUP BY 1""")
def geo_stats(spark, d) -> DataFrame:
    return flights(spark, d).groupBy("on_ground").agg(
        F.count(F.lit(1)).alias("n"), F.round(geo.feet(F.avg("altitude")), 2).alias("mean_altitude_ft"),
        F.round(geo.knots(F.max("velocity")), 2).alias("max_speed_kt"),
        F.countDistinct("origin_country").alias("countries"), F.count_if(geo.airborne()).alias("airborne"))


@query("geo_dead_reckoning", f"""
  SELECT event_id, CAST(i AS INTEGER) AS point,
    round(greatest(-85, least(85, latitude + cos(radians(heading)) * velocity * (i / 40.0 * 1500) / 1000 / 111)), 7) AS track_lat,
    round(longitude + sin(radians(heading)) * velocity * (i / 40.0 * 1500) / 1000 / 111 / greatest(cos(radians(latitude)), 0.1), 7) AS track_lon,
    round(greatest(0, altitude + vertical_rate * (i / 40.0 * 1500)), 4) AS track_alt
  FROM {_FLIGHTS}, range(41) r(i) WHERE NOT on_ground AND velocity > 10""")
def geo_dead_reckoning(spark, d) -> DataFrame:
    flying = spread(flights(spark, d).filter(geo.airborne()))
    return geo.dead_reckon(flying).select(
        "event_id", "point", F.round("track_lat", 7).alias("track_lat"),
        F.round("track_lon", 7).alias("track_lon"), F.round("track_alt", 4).alias("track_alt"))


_HOME_SQL = "(VALUES " + ", ".join(
    f"('{c}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for c, a, o in COUNTRY_CENTROIDS) + ") AS h(country, hlat, hlon)"


@query("geo_origin_distance", f"""
  SELECT event_id, origin_country, round(sqrt((latitude - hlat) * (latitude - hlat) + (longitude - hlon) * (longitude - hlon)), 6) AS distance_deg
  FROM {_FLIGHTS} JOIN {_HOME_SQL} ON origin_country = country""")
def geo_origin_distance(spark, d) -> DataFrame:
    return geo.origin_distance(flights(spark, d), geo.centroids(spark)).select(
        "event_id", "origin_country", F.round("distance_deg", 6).alias("distance_deg"))


def vectors_of_events(spark, d) -> DataFrame:
    """Events as positional arrays; errors are too short, some purchases lack a latitude."""
    e = load(spark, d, "events")
    text = lambda c: F.expr(c).cast("string")
    lat = F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0), None).otherwise(text(f"CAST({LAT} AS DOUBLE)"))
    speed = F.when(F.col("event_type") == "click", "fast").otherwise(F.col("value").cast("string"))
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    entries = [
        F.concat(F.lit("icao"), F.col("user_id")), F.concat(F.lit("CS"), F.col("event_id")), F.lit("Malta"),
        secs.cast("string"), secs.cast("string"), text(f"CAST({LON} AS DOUBLE)"), lat, F.lit(None).cast("string"),
        (F.col("event_type") == "signup").cast("string"), speed, text("CAST(event_id % 360 AS DOUBLE)"), F.lit("0.5"),
        F.lit("[1,2]"), F.lit("1000.0"), F.lit(None).cast("string"), F.lit("false"), F.lit("0")]
    full = F.array(*entries)
    state = F.when(F.col("event_type") == "error", F.slice(full, 1, 16)).otherwise(full)
    return e.select("event_id", secs.alias("time"), state.alias("state"))


_PARSED = f"""SELECT 'icao' || user_id AS icao24, 'CS' || event_id AS callsign, date_trunc('second', ts) AS time_position,
  CAST({LON} AS DOUBLE) AS longitude, CAST({LAT} AS DOUBLE) AS latitude, event_type = 'signup' AS on_ground,
  CASE WHEN event_type <> 'click' THEN value END AS velocity, CAST(NULL AS INTEGER) AS category
  FROM events WHERE event_type <> 'error' AND NOT (event_type = 'purchase' AND user_id % 3 = 0)"""
PARSED_COLUMNS = ["icao24", "callsign", "time_position", "longitude", "latitude", "on_ground", "velocity", "category"]


@query("state_vector_parse", _PARSED)
def state_vector_parse(spark, d) -> DataFrame:
    return parse_state_vectors(vectors_of_events(spark, d)).select(*PARSED_COLUMNS)
