"""Named row rules: log, drop or fail; quarantine; counts per rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

ACTIONS = ("log", "drop", "fail")


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    action: str = "log"

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"action must be one of {ACTIONS}, not {self.action!r}")

    @property
    def holds(self) -> Column:
        """True where the row satisfies the rule; an unknown (NULL) predicate is a violation."""
        return F.coalesce(F.expr(self.predicate).cast("boolean"), F.lit(False))


class ExpectationFailed(RuntimeError):
    """A ``fail`` rule was violated; nothing has been written."""


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def clean(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that pass every ``drop`` rule.  A row breaking a ``fail`` rule stops the job.

    Drop rules alone are a plain filter that reaches the scan.  A fail rule must see exactly
    the rows of ``df``; its condition depends on the row's place, so the planner cannot test
    it on rows that a join or filter below would have removed.
    """
    keep = _all(r.holds for r in rules if r.action == "drop")
    in_place = F.monotonically_increasing_id() >= 0
    for r in rules:
        if r.action == "fail":
            stop = F.raise_error(F.lit(f"expectation violated: {r.name}")).cast("boolean")
            keep = F.when(r.holds & in_place, keep).otherwise(stop)
    return df.filter(keep)


def broken_rules(rules: list[Rule]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~r.holds, F.lit(r.name)) for r in rules]).cast("array<string>"))


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that break at least one ``drop`` rule, with the names of all rules they break."""
    drops = [r for r in rules if r.action == "drop"]
    return df.filter(~_all(r.holds for r in drops)).withColumn("failed_rules", broken_rules(rules))


def metrics(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: passed and failed row counts, from a single pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(r.holds).alias(f"_p{i}") for i, r in enumerate(rules)],
    )
    per_rule = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"),
            F.col(f"_p{i}").alias("passed"), (F.col("_rows") - F.col(f"_p{i}")).alias("failed"))
        for i, r in enumerate(rules)
    ])
    return counts.select(F.inline(per_rule))


def observed(df: DataFrame, rules: list[Rule], name: str) -> tuple[DataFrame, Observation]:
    """The cleaned rows, counting violations while they are written (no second pass)."""
    seen = Observation(name)
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~r.holds).alias(f"failed: {r.name}") for r in rules])
    return clean(counted, rules), seen


def write_checked(df: DataFrame, path: str, rules: list[Rule], mode: str = "append") -> None:
    """Write the cleaned rows to a parquet table, or leave the table as it was.

    A failed append commits nothing.  An overwrite would empty the target first, so its
    ``fail`` rules are counted beforehand.
    """
    if mode != "append":
        fails = [r for r in rules if r.action == "fail"]
        if fails:
            bad = metrics(df, fails).filter("failed > 0").first()
            if bad:
                raise ExpectationFailed(f"{bad.rule}: {bad.failed} rows")
    clean(df, rules).write.mode(mode).parquet(path)
