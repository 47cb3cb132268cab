"""Change data capture, upserts and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators.latest import latest_rows, tie_number
from weir.operators.ordered import next_in_order

START, END = "__START_AT", "__END_AT"


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``, then the one with the greatest hash of the other columns, for
    current rows and for versions alike."""
    return latest_rows(df, keys, order)


def scd1(changes, keys, seq, delete_when: str | None = None, except_cols=()) -> DataFrame:
    """Current rows: highest sequence per key wins; a key whose last change deletes it is gone."""
    last = latest_per_key(changes, keys, [seq])
    if delete_when:
        last = last.filter(f"NOT coalesce({delete_when}, false)")
    return last.drop(*except_cols)


def scd2(changes, keys, seq, delete_when: str | None = None, except_cols=(), max_rows=None) -> DataFrame:
    """Every version with its half-open validity; a delete ends a version and starts none.

    Of several changes with one sequence number the last in tie order is kept.
    """
    tied = changes.withColumn("_tie", tie_number(changes, [*keys, seq]))
    versions = next_in_order(tied, keys, [seq, "_tie"], END, max_rows=max_rows).drop("_tie")
    versions = versions.filter(F.col(END).isNull() | (F.col(END) > F.col(seq)))
    if delete_when:
        versions = versions.filter(f"NOT coalesce({delete_when}, false)")
    return versions.withColumn(START, F.col(seq)).drop(*except_cols)


def as_of(versions: DataFrame, point) -> DataFrame:
    """The versions valid at ``point``."""
    point = F.lit(point)
    return versions.filter((F.col(START) <= point) & (F.col(END).isNull() | (F.col(END) > point)))


def as_of_version(changes, keys, seq, point, delete_when=None) -> DataFrame:
    """The table as it was after change ``point`` (time travel over the change log)."""
    return scd1(changes.filter(F.col(seq) <= F.lit(point)), keys, seq, delete_when)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Merge: matched keys take all columns of ``updates``, new keys are added."""
    have = {f.name: f.dataType for f in target.schema}
    got = {f.name: f.dataType for f in updates.schema}
    if have != got:
        raise ValueError(f"schemas differ: {have} and {got}")
    return updates.unionByName(target.join(updates.select(*keys), keys, "left_anti"))


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(unprocessed(rows, target, keys))


def unprocessed(source: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is not yet in ``done`` (which may not exist yet)."""
    if done is None:
        return source
    return source.join(done.select(*keys), keys, "left_anti")


def conditional_update(df: DataFrame, where: str, assignments: dict[str, str]) -> DataFrame:
    """UPDATE … SET … WHERE as a projection; a NULL condition leaves the row alone."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    types = {f.name: f.dataType for f in df.schema}
    new = {c: F.when(hit, F.expr(e).cast(types[c])).otherwise(F.col(c)) for c, e in assignments.items()}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def delete_where(df: DataFrame, where: str) -> DataFrame:
    return df.filter(f"NOT coalesce({where}, false)")


def change_set(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys to insert, update or delete to bring a copy of ``old`` in step with ``new``.

    Only keys and content digests are shuffled, never the content.
    """
    def digest(df, name):
        content = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
        return df.select(*keys, content.alias(name))

    both = digest(old, "_old").join(digest(new, "_new"), keys, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update"))
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change")


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append under a changed schema: a column missing on one side is NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


def merge_partials(parts: list[DataFrame], by: list[str], sums: list[str]) -> DataFrame:
    """Add partial counts and sums of new rows to the stored ones."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
