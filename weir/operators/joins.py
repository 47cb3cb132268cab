"""Joins of a keyed table with many rows per key, also when one key holds much of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from weir.operators.ordered import HOT_ROWS
from weir.session import pinned

_SALT = "_salt"


def one_to_many(one: DataFrame, many: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame:
    """``one`` left join ``many``; keys are unique in ``one``.

    A left join cannot split a hot key on its right side.  Here the matches are an inner join
    in which the rows of hot keys are spread over several tasks (and only the hot keys' rows
    of ``one`` are copied to each); rows of ``one`` without a match are added by an anti join
    against the distinct keys.  Only one count comes to the driver.
    """
    max_rows = max_rows or HOT_ROWS
    sizes = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= max_rows:
        return one.join(many, keys, "left")
    parts = math.ceil(largest / max_rows)
    hot = pinned(sizes.filter(F.col("_n") > max_rows).select(*keys, F.lit(True).alias("_hot")), "hot")
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(parts))).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long")))
    left = one.join(hot, keys, "left").withColumn(_SALT, F.explode(copies)).drop("_hot")
    right = many.join(hot, keys, "left").withColumn(_SALT, spread.cast("long")).drop("_hot")
    matched = left.join(right, [*keys, _SALT]).drop(_SALT)
    alone = one.join(many.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
