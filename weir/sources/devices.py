"""Nested device messages as flat sensor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import finite

# record name in the message → (prefix of the flat columns, its fields)
_PARTS = {
    "acceleration": ("acceleration_", ("x", "y", "z")),
    "rotationRate": ("rotation_", ("alpha", "beta", "gamma")),
    "orientation": ("orientation_", ("alpha", "beta", "gamma")),
    "location": ("", ("latitude", "longitude", "altitude", "accuracy", "speed", "heading")),
    "magnetometer": ("magnetic_", ("x", "y", "z")),
}


def message_schema() -> str:
    """All leaves as text: a number that is not one must not void the whole message."""
    parts = [f"{rec}: STRUCT<{', '.join(f'{f}: STRING' for f in fields)}>" for rec, (_, fields) in _PARTS.items()]
    return f"STRUCT<clientId: STRING, timestamp: STRING, {', '.join(parts)}>"


def normalize_device_messages(df: DataFrame, json_col: str) -> DataFrame:
    """One flat row per message; a message without a readable ISO time is dropped.

    NaN and infinite numbers become NULL; times are microseconds since the epoch (UTC).
    """
    def instant(text):
        return F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text).try_cast("timestamp")

    # a list of at most one message: it is parsed once, also for the test that drops it
    parsed = F.array(F.from_json(json_col, message_schema()))
    usable = F.filter(parsed, lambda m: instant(m["timestamp"]).isNotNull())
    rows = df.select("*", F.explode(usable).alias("_m")).drop(json_col)
    rows = rows.withColumn("_at", instant(F.col("_m.timestamp")))
    numbers = {
        f"{prefix}{f}": finite(F.col(f"_m.{rec}.{f}"))
        for rec, (prefix, fields) in _PARTS.items() for f in fields}
    return rows.withColumns({
        "id": F.uuid(), "client_id": F.col("_m.clientId"), "timestamp": F.unix_micros("_at"),
        **numbers,
        "received_at": F.unix_micros(F.current_timestamp()), "processing_time_ms": F.lit(0).cast("long"),
    }).drop("_m", "_at")
