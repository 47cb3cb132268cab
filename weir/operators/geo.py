"""Positions: region boxes, unit conversion, projected tracks, distance to a home point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions.fixed_values import (
    COUNTRY_CENTROIDS, FEET_PER_METRE, KM_PER_DEGREE, KNOTS_PER_MS, REGION_BOXES)
from weir.tables import literal_table


def in_box(region: str, lat: str = "latitude", lon: str = "longitude") -> Column:
    south, north, west, east = REGION_BOXES[region]
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def region_filter(df: DataFrame, region: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.filter(in_box(region, lat, lon))


def with_regions(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One row per region a position lies in (row-local, no join)."""
    names = F.array_compact(F.array(*[F.when(in_box(r, lat, lon), F.lit(r)) for r in REGION_BOXES]))
    return df.withColumn("region", F.explode(names))


def altitude(geo: str = "geo_altitude", baro: str = "baro_altitude") -> Column:
    return F.coalesce(F.col(geo), F.col(baro), F.lit(0.0))


def airborne(ground: str = "on_ground", speed: str = "velocity", slowest: float = 10) -> Column:
    return ~F.col(ground) & (F.col(speed) > slowest)


def feet(metres: Column) -> Column:
    return metres * FEET_PER_METRE


def knots(ms: Column) -> Column:
    return ms * KNOTS_PER_MS


def dead_reckon(df: DataFrame, minutes: int = 25, segments: int = 40) -> DataFrame:
    """Straight-line track ahead: one row per point 0 … ``segments``.

    Latitude is held within ±85 degrees, height above ground; near the poles the longitude
    step uses a cosine of at least 0.1.
    """
    at = df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(segments))))
    secs = F.col("point") / F.lit(segments) * F.lit(minutes * 60)
    track = at.withColumn("_secs", secs).withColumn(
        "_deg", F.col("velocity") * F.col("_secs") / 1000 / KM_PER_DEGREE)
    course = F.radians("heading")
    squeeze = F.greatest(F.cos(F.radians("latitude")), F.lit(0.1))
    ahead = F.col("latitude") + F.cos(course) * F.col("_deg")
    return track.withColumns({
        "track_lat": F.greatest(F.lit(-85.0), F.least(F.lit(85.0), ahead)),
        "track_lon": F.col("longitude") + F.sin(course) * F.col("_deg") / squeeze,
        "track_alt": F.greatest(F.lit(0.0), F.col("altitude") + F.col("vertical_rate") * F.col("_secs")),
    }).drop("_secs", "_deg")


def centroids(spark) -> DataFrame:
    return literal_table(spark, COUNTRY_CENTROIDS, "country STRING, home_lat DOUBLE, home_lon DOUBLE")


def origin_distance(df: DataFrame, homes: DataFrame, country: str = "origin_country") -> DataFrame:
    """Distance in degrees to the home point of the row's country; unknown countries drop out.

    ``homes`` is the short fixed list of ``centroids``, sent to every task.
    """
    near = df.join(homes, F.col(country) == F.col("country"), "inner").drop("country")
    dlat, dlon = F.col("latitude") - F.col("home_lat"), F.col("longitude") - F.col("home_lon")
    return near.withColumn("distance_deg", F.sqrt(dlat * dlat + dlon * dlon))
