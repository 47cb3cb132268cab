"""Ordered computations per key that stay parallel when one key holds much of the table.

A plain window sorts a whole key in one task.  Here the rows of a hot key are first cut
into ordered segments at quantiles of the sort columns; windows run inside a segment, and
one small row per segment carries counts, sums or neighbours over to the next segment.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from weir.session import pinned

SEG = "_segment"
HOT = "_hot"                # rows whose key was cut
HOT_ROWS = 4_000_000        # rows of one key that one task may sort
MAX_PIECES = 2_000          # cut points per hot key
_RADIX = 10_000             # even, > 2 * MAX_PIECES + 1: keeps nested segment numbers in order


@dataclass(frozen=True)
class Segments:
    """Rows with a segment number per key; ``split`` is False when no key was hot."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, SEG).orderBy(*self.order)

    def carry(
        self,
        rows: DataFrame,
        per_segment: dict[str, Column],
        over_segments: dict[str, Callable[[WindowSpec], Column]],
    ) -> DataFrame:
        """``rows`` with what the other segments of a hot key hand over (NULL for other keys).

        ``per_segment`` aggregates the hot rows to one row per segment, ``over_segments`` are
        windows over those (at most a few thousand per key).  The result is stored, so its
        size is known and a short one is broadcast: hot or not, the rows move only once.
        """
        seg = self.df.filter(HOT).groupBy(*self.keys, SEG).agg(*[c.alias(n) for n, c in per_segment.items()])
        w = Window.partitionBy(*self.keys).orderBy(SEG)
        handed = seg.select(*self.keys, SEG, *[f(w).alias(n) for n, f in over_segments.items()])
        return null_safe_left_join(rows, pinned(handed, "carry"), [*self.keys, SEG])


def null_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys where NULL equals NULL; key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def segment(df: DataFrame, keys: list[str], order: list[str], max_rows: int | None = None) -> Segments:
    """Number the ordered segments of every key.

    ``order`` columns are numbers or timestamps.  Only one row (the largest key's size)
    comes to the driver; without a hot key nothing else is done.
    """
    max_rows = max_rows or HOT_ROWS
    cuts = _cut_points(df, keys, order[0], max_rows)
    if cuts is None:
        plain = df.withColumns({SEG: F.lit(0).cast("long"), HOT: F.lit(False)})
        return Segments(plain, tuple(keys), tuple(order), False)
    out = _numbered(df, keys, order[0], cuts).withColumns({SEG: F.coalesce("_no", F.lit(0)), HOT: F.col("_no").isNotNull()})
    out = out.drop("_no")
    for col in order[1:]:
        # one repeated sort value can outgrow a task too: cut such a segment by the next column
        if cuts.filter("_tied").isEmpty():
            break
        cuts = _cut_points(out.filter(F.col(HOT) & (F.pmod(SEG, F.lit(2)) == 1)), [*keys, SEG], col, max_rows)
        if cuts is None:
            break
        inner = _numbered(out, [*keys, SEG], col, cuts)
        out = inner.withColumn(SEG, F.col(SEG) * _RADIX + F.coalesce("_no", F.lit(0))).drop("_no")
    return Segments(out, tuple(keys), tuple(order), True)


def _cut_points(rows: DataFrame, keys: list[str], col: str, max_rows: int) -> DataFrame | None:
    """Quantiles of ``col`` for every key with more than ``max_rows`` rows, as many as its size
    asks for; ``_tied`` marks keys in which one value, or none, takes up a whole step."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= max_rows:
        return None
    pieces = min(MAX_PIECES, math.ceil(largest / max_rows))
    probs = [i / pieces for i in range(1, pieces)]
    hot = pinned(sizes.filter(F.col("_n") > max_rows).select(*[F.col(k).alias(f"_h_{k}") for k in keys]), "hot")
    kind = rows.schema[col].dataType.simpleString()
    hot_rows = rows.join(hot, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], "left_semi")
    found = hot_rows.groupBy(*keys).agg(
        F.coalesce(F.percentile_approx(col, probs, F.lit(10 * pieces)), F.array().cast(f"array<{kind}>")).alias("_q"),
        F.count_if(F.col(col).isNull()).alias("_nulls"), F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(pieces) / F.ceil(F.col("_n") / max_rows)))
    thinned = found.withColumn("_q", F.filter("_q", lambda _, i: (i + 1) % step == 0))
    # sketches merge in arrival order: fix the cut points once, so that every use agrees
    return pinned(thinned.select(
        *keys, F.array_distinct("_q").alias("_cuts"),
        ((F.size(F.array_distinct("_q")) < F.size("_q")) | (F.col("_nulls") > max_rows)).alias("_tied")), "cuts")


def _numbered(df: DataFrame, keys: list[str], col: str, cuts: DataFrame) -> DataFrame:
    """Adds ``_no``: the segment of each row, odd for rows equal to a cut point and -1 for rows
    without a value, which sort first; NULL for keys without cut points."""
    joined = null_safe_left_join(df, cuts.drop("_tied"), keys)
    below = F.size(F.filter("_cuts", lambda c: c < F.col(col)))
    upto = F.size(F.filter("_cuts", lambda c: c <= F.col(col)))
    number = F.when(F.col(col).isNull(), -1).otherwise(below + upto)
    return joined.withColumn("_no", F.when(F.col("_cuts").isNotNull(), number).cast("long")).drop("_cuts")


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], rn: str = "rn", total: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """``row_number`` per key, and the key's row count if ``total`` is named."""
    s = segment(df, keys, order, max_rows)
    rows = s.df.withColumn(rn, F.row_number().over(s.window).cast("long"))
    if total:
        rows = rows.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys, SEG)))
    if s.split:
        rows = s.carry(
            rows, {"_n": F.count(F.lit(1))},
            {
                "_before": lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                "_all": lambda w: F.sum("_n").over(
                    w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            },
        ).withColumn(rn, F.col(rn) + F.coalesce("_before", F.lit(0)))
        if total:
            rows = rows.withColumn(total, F.coalesce("_all", total))
        rows = rows.drop("_before", "_all")
    return rows.drop(SEG, HOT)


def next_in_order(
    df: DataFrame, keys: list[str], order: list[str], alias: str, max_rows: int | None = None,
) -> DataFrame:
    """The first sort column of the key's following row (NULL for the last one)."""
    s = segment(df, keys, order, max_rows)
    rows = s.df.withColumn(alias, F.lead(order[0]).over(s.window))
    if s.split:
        rows = s.carry(
            rows, {"_first": F.min(order[0])}, {"_next": lambda w: F.lead("_first").over(w)},
        ).withColumn(alias, F.coalesce(alias, "_next")).drop("_next")
    return rows.drop(SEG, HOT)
