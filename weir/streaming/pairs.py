"""Joins of two streams, and duplicates across batches, with state that leaves by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_R = "_right_"


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str,
                 delay: str, how: str = "left_outer") -> DataFrame:
    """Rows of ``right`` with the key of a ``left`` row and a time from its time on to ``within`` later.

    Both streams have a watermark of ``delay`` behind their latest time.  The bound frees the state: a
    row leaves it when the watermark says that no partner can come any more, and a ``left_outer`` row
    without partner is put out then.
    """
    named = right.withColumnsRenamed({c: f"{_R}{c}" for c in [*keys, right_time]})
    there = F.col(f"{_R}{right_time}")
    same = [F.col(k) == F.col(f"{_R}{k}") for k in keys]
    bound = (there >= F.col(left_time)) & (there <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    condition = bound
    for s in same:
        condition = condition & s
    joined = left.withWatermark(left_time, delay).join(named.withWatermark(f"{_R}{right_time}", delay), condition, how)
    return joined.drop(*[f"{_R}{k}" for k in keys]).withColumnRenamed(f"{_R}{right_time}", right_time)


def with_window_stats(rows: DataFrame, measures: DataFrame, time: str, length: str, offset: str, delay: str, **stats) -> DataFrame:
    """``rows`` beside the statistics of ``measures`` (a stream too) over the window both lie in.

    A window's statistics come out when the watermark has passed its end, and only then do its rows;
    both leave the state with it.
    """
    def window(df):
        return df.withWatermark(time, delay).withColumn("window", F.window(time, length, startTime=offset))

    totals = measures.withWatermark(time, delay).groupBy(F.window(time, length, startTime=offset)).agg(
        *[c.alias(n) for n, c in stats.items()])
    return window(rows).join(totals, "window")


def first_of_copies(rows: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """The first row per key; copies that come within ``horizon`` of event time are dropped, whatever
    batch they come in, and older keys leave the state.  Later copies are late rows, which go too."""
    return rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)
