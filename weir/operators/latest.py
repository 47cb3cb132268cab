"""The last row per key, found on numbers.

An aggregate that carries whole rows has to sort them.  Here only the order and a tie number of
fixed width go through a hash aggregate, with map-side combine; the rows themselves are fetched by a
semi-join against one small row per key, which Spark broadcasts when it is short.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)
_RANK, _FACTOR = T.DecimalType(38, 0), T.DecimalType(19, 0)
_TIES = 1 << 62
_BELOW_ALL = Decimal(-(1 << 63) - 1)


def _number(col: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(col).cast("timestamp"))
    return F.col(col).cast("long")


def _comparable(kind: T.DataType) -> bool:
    return not any(k in kind.simpleString() for k in ("map<", "variant"))


def tie_number(df: DataFrame, besides: list[str]) -> Column:
    """A hash of all other columns: it decides between rows of one place."""
    rest = [c for c in df.columns if c not in besides and _comparable(df.schema[c].dataType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0).cast("long")


def latest_rows(df: DataFrame, keys: list[str], order: list[str], tie: Column | None = None) -> DataFrame:
    """The last row per key by the one or more whole-number or time columns of ``order`` (NULL first),
    then by ``tie``; of rows alike one.  NULL keys are a key.  Rows that differ in nothing but a column
    that cannot be compared, or whose order is text or a fraction, take the way over whole rows.
    """
    kinds = [df.schema[c].dataType for c in order]
    tie = tie if tie is not None else tie_number(df, [*keys, *order])
    if len(order) != 1 or not isinstance(kinds[0], _WHOLE) or not all(_comparable(f.dataType) for f in df.schema):
        return _by_whole_rows(df, keys, order, tie)
    number = F.coalesce(_number(order[0], kinds[0]).cast(_RANK), F.lit(_BELOW_ALL).cast(_RANK))
    # 63 bits of order and sign above 62 bits of tie: below 10^38
    packed = number * F.lit(_TIES).cast(_FACTOR) + (F.shiftright(tie, 2) + F.lit(1 << 61)).cast(_FACTOR)
    ranked = df.withColumn("_rank", packed.cast(_RANK))
    best = ranked.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(F.max("_rank").alias("_best"))
    same = F.col("_rank") == F.col("_best")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return ranked.join(best, same, "left_semi").distinct().drop("_rank")


def _by_whole_rows(df: DataFrame, keys: list[str], order: list[str], tie: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, tie)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)
