"""Grouped reports that go beyond a single ``groupBy().agg``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rate_pct(condition: Column, digits: int = 2) -> Column:
    """Share of rows that meet ``condition``, in percent, as an aggregate."""
    return F.round(F.count_if(condition) * 100.0 / F.count(F.lit(1)), digits)


def share_of_total(df: DataFrame, by: str, digits: int = 1) -> DataFrame:
    """Row count per value of ``by`` and its share of all rows in percent.

    The total is a scalar subquery over the grouped counts, not a second scan in a window.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select(by, "n", F.round(F.col("n") * 100.0 / total, digits).alias("share_pct"))


def totals_and_breakdown(df: DataFrame, by: str, label: str, title: str) -> DataFrame:
    """The grand total and the count per class in one result."""
    per_class = df.groupBy(by).agg(F.count(F.lit(1)).alias("num_events"))
    per_class = per_class.select(F.lit(title).alias(label), F.col(by), "num_events")
    total = per_class.agg(F.coalesce(F.sum("num_events"), F.lit(0)).alias("num_events")).select(
        F.lit(title).alias(label), F.lit("ALL").alias(by), "num_events")
    return total.unionAll(per_class)


def mean_of_group_sums(df: DataFrame, by: list[str], value: str, alias: str) -> DataFrame:
    """Two-level aggregate: sum per group, then the mean of those sums."""
    return df.groupBy(*by).agg(F.sum(value).alias("_s")).agg(F.avg("_s").alias(alias))


def busiest(df: DataFrame, by: Column, alias: str) -> DataFrame:
    """The value of ``by`` with most rows (the smallest one on a tie) and its row count."""
    counts = df.groupBy(by.alias(alias)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), alias).limit(1)


def histogram(df: DataFrame, value: str, bin_size: float) -> DataFrame:
    start = (F.floor(F.col(value) / F.lit(bin_size)) * F.lit(bin_size)).cast("double")
    return df.groupBy(start.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, group: list[str], member: list[str]) -> DataFrame:
    """Members with the highest row count of their group, ties kept.

    ``dense_rank() <= 1`` lets the planner drop all lower ranks before the shuffle too.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*group, *member).agg(F.count(F.lit(1)).alias("event_count"))
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy(F.desc("event_count")))
    return counts.withColumn("_rank", rank).filter("_rank <= 1").drop("_rank")
