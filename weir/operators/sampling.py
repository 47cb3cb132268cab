"""Reproducible samples and splits, and even subsamples of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.operators.ordered import number_rows

BUCKETS = 65_536


def hash_bucket(key: Column) -> Column:
    """0 … 65535 from the first four hex digits of the key's md5 (same on any engine)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int")


def hash_sample(df: DataFrame, key: str, percent: float) -> DataFrame:
    """A fixed sample of keys: a key is always in or always out."""
    return df.filter(hash_bucket(F.col(key)) < int(BUCKETS * percent / 100))


def hash_split(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Assign each key to a named part; stable when rows are added."""
    bucket, edge, total = hash_bucket(F.col(key)), 0.0, sum(weights.values())
    part, names = None, list(weights)
    for name in names[:-1]:
        edge += weights[name]
        hit = bucket < int(BUCKETS * edge / total)
        part = F.when(hit, name) if part is None else part.when(hit, name)
    last = F.lit(names[-1])
    return df.withColumn("split", last if part is None else part.otherwise(last))


def systematic_sample(df, group: Column, order: list[str], step: int, offset: int = 0, max_rows=None) -> DataFrame:
    """Every ``step``-th row of each group in sort order (``rn % step = offset``)."""
    numbered = number_rows(df.withColumn("_g", group), ["_g"], order, "row_num", max_rows=max_rows)
    return numbered.filter(F.col("row_num") % step == offset).drop("_g")


def even_subsample(df, keys: list[str], order: list[str], n: int, max_rows=None) -> DataFrame:
    """At most ``n`` rows per key, evenly spread over its sort order.

    The same rows as the first one of each ``ntile(n)`` bucket, found by arithmetic on the
    row number: the first ``count % n`` buckets hold one row more.
    """
    rows = number_rows(df, keys, order, "_rn", "_cnt", max_rows=max_rows)
    small = F.floor(F.col("_cnt") / n)
    extra = F.col("_cnt") % n
    pos = F.col("_rn") - 1
    in_large = pos < extra * (small + 1)
    bucket = F.when(in_large, F.floor(pos / (small + 1))).otherwise(
        extra + F.floor((pos - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    first = F.when(in_large, pos % (small + 1) == 0).otherwise(
        (pos - extra * (small + 1)) % F.greatest(small, F.lit(1)) == 0)
    return rows.filter(first).withColumn("bucket", (bucket + 1).cast("int")).drop("_rn", "_cnt")


def stride_sample(df, keys: list[str], order: list[str], max_points: int, max_rows=None) -> DataFrame:
    """Every ``max(1, floor(n / max_points))``-th row of each key."""
    rows = number_rows(df, keys, order, "_rn", "_cnt", max_rows=max_rows)
    step = F.greatest(F.lit(1), F.floor(F.col("_cnt") / max_points))
    return rows.filter((F.col("_rn") - 1) % step == 0).drop("_rn", "_cnt")
