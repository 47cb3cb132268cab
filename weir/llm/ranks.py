"""Numbers of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weir.llm.common import pinned


def numbered(rows: DataFrame, group: list[str], order: list[str], index: str = "idx", size: str = "n") -> DataFrame:
    """``rows`` with their place in their group (``index``, from 0, by ``order``, NULL first) and the
    group's ``size``.  Without group columns all rows are one group.

    The rows are dealt by ranges of group and order, so that a large group lies in many tasks, and
    stored; a row's place is its place in its task plus the group's rows in tasks before, which one
    small row per group and task tells.  Rows alike in group and order are numbered in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    at = F.monotonically_increasing_id()
    placed = pinned(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at), "placed")
    task = F.shiftrightunsigned("_at", 33)
    runs = placed.groupBy(*group, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    known = pinned(runs.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_task").alias("_of"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_size")), "runs")
    same = F.col("_of") == task
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(known, same).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias(index), F.col("_size").alias(size))
