"""Masks by role, pseudonymous and full views, classification, usage audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weir.functions.fixed_values import MASK_FOR_ANALYSTS, MASK_LEAD
from weir.operators.joins import one_to_many

Mask = Callable[[Column, str], Column]


def mask_tail(constant: str = MASK_FOR_ANALYSTS, lead: str = MASK_LEAD, shown: int = 4) -> Mask:
    """admin sees the value, analyst a constant, everybody else only its last characters."""
    def apply(col: Column, role: str) -> Column:
        if role == "admin":
            return col
        if role == "analyst":
            return F.lit(constant)
        return F.concat(F.lit(lead), F.right(col, F.lit(shown)))
    return apply


def redact(word: str = "***REDACTED***") -> Mask:
    """admin sees the value, everybody else a fixed word."""
    return lambda col, role: col if role == "admin" else F.lit(word)


def mask_columns(df: DataFrame, masks: dict[str, Mask], role: str) -> DataFrame:
    return df.withColumns({c: m(F.col(c), role) for c, m in masks.items()})


def views_by_role(df: DataFrame, masks: dict[str, Mask], roles: list[str], column: str = "role") -> DataFrame:
    """What each role sees, one row per role and row of ``df``, in one scan."""
    rows = df.withColumn(column, F.explode(F.array(*[F.lit(r) for r in roles])))

    def seen(name: str) -> Column:
        return F.coalesce(*[F.when(F.col(column) == r, masks[name](F.col(name), r)) for r in roles])

    return rows.withColumns({name: seen(name) for name in masks})


def padded_id(key: str, prefix: str = "EMP_", width: int = 6) -> Column:
    """Readable pseudonym; the key stays visible in it, use ``salted_id`` to hide it.

    A key longer than the width is kept whole, so that two people never share one.
    """
    text = F.col(key).cast("string")
    wide = F.greatest(F.length(text), F.lit(width))
    return F.concat(F.lit(prefix), F.lpad(text, wide, F.lit("0")))


def salted_id(key: str, salt: str, prefix: str = "EMP_") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256))


def analyst_view(people, pay, reviews, excluded: list[str], pseudonym: Column | None = None) -> DataFrame:
    """Statistics without identity: pseudonyms, years instead of dates, some departments left out.

    ``pay`` has one row per employee, ``reviews`` any number.
    """
    visible = people.filter(~F.col("department").isin(excluded)).join(pay, "employee_id", "left")
    name = padded_id("employee_id") if pseudonym is None else pseudonym
    return (
        one_to_many(visible, reviews, ["employee_id"]).select(
            name.alias("anonymous_id"), "department",
            F.year("hire_date").alias("hire_year"), "base_salary", "bonus", "stock_options",
            F.year("effective_date").alias("comp_year"), "rating",
            F.quarter("review_date").alias("review_quarter"),
            F.year("review_date").alias("review_year")))


def admin_view(people, pay, reviews, cases) -> DataFrame:
    """Everything, joined along the employee key; employees without a match are kept.

    ``pay`` and ``cases`` have at most one row per employee, ``reviews`` any number.
    """
    single = people.join(pay, "employee_id", "left").join(cases, "employee_id", "left")
    return one_to_many(single, reviews, ["employee_id"])


def _enough(df: DataFrame, least: int) -> DataFrame:
    return df.filter(F.col("employee_count") >= least) if least > 1 else df


def analyze_performance(view: DataFrame, this_year: int, min_group: int = 1) -> DataFrame:
    rated = view.filter("rating IS NOT NULL").groupBy("department").agg(
        F.avg("rating").alias("avg_rating"), F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.countDistinct("anonymous_id").alias("employee_count"),
        F.avg(F.lit(this_year) - F.col("hire_year")).alias("avg_tenure_years"))
    return _enough(rated, min_group)


def analyze_operations(view: DataFrame, min_group: int = 1) -> DataFrame:
    paid = view.filter("base_salary IS NOT NULL").groupBy("department").agg(
        F.countDistinct("anonymous_id").alias("employee_count"),
        F.avg("base_salary").alias("avg_salary"), F.avg("bonus").alias("avg_bonus"),
        F.avg(F.col("base_salary") + F.col("bonus")).alias("avg_total_comp"),
        F.avg("stock_options").alias("avg_stock_options"))
    return _enough(paid, min_group)


CLASS_PROPERTIES = ("data_classification", "contains_pii", "governance_enabled")


def classify_table(spark: SparkSession, table: str, classification: str, contains_pii: bool) -> None:
    values = (classification, str(contains_pii).lower(), "true")
    props = ", ".join(f"'{k}' = '{v}'" for k, v in zip(CLASS_PROPERTIES, values))
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({props})")


def classifications(spark: SparkSession, tables: list[str]) -> DataFrame:
    """The classification of catalog tables, one row per table."""
    out = None
    for name in tables:
        props = spark.sql(f"SHOW TBLPROPERTIES {name}").filter(F.col("key").isin(*CLASS_PROPERTIES))
        row = props.agg(*[F.max(F.when(F.col("key") == p, F.col("value"))).alias(p) for p in CLASS_PROPERTIES])
        row = row.select(F.lit(name).alias("table_name"), *CLASS_PROPERTIES)
        out = row if out is None else out.unionAll(row)
    return out


def usage_audit(log: DataFrame, as_of: str, days: int, by: list[str], source: str, at: str) -> DataFrame:
    """Who still reads which source since ``as_of - days``: last access, references, tables.

    Counting per (who, source) first keeps the collected set down to distinct names.
    """
    recent = log.filter(F.col(at) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY"))
    per_source = recent.groupBy(*by, source).agg(
        F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return per_source.groupBy(*by).agg(
        F.max("_last").alias("last_accessed"), F.sum("_n").alias("reference_count"),
        F.array_join(F.array_sort(F.collect_list(source)), ",").alias("tables_used"))


def text_usage(log: DataFrame, text: str, needle: str, preview: int = 500) -> DataFrame:
    """Rows whose whole text mentions ``needle`` in any case, with a short preview column."""
    hit = F.lower(text).contains(needle.lower())
    return log.filter(hit).withColumn("preview", F.left(F.col(text), F.lit(preview)))
