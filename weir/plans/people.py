"""Personnel data under governance: employees are customers, reviews are their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.fixed_values import MASK_FOR_ANALYSTS, MASK_LEAD
from weir.functions.sql_functions import register_masks
from weir.operators import governance as gov
from weir.registry import query
from weir.tables import load

EXCLUDED = ["BUILDING"]       # the department held back from analysts
THIS_YEAR = 2024


def employees(spark, d) -> DataFrame:
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    key = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        key.alias("employee_id"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"), F.concat(F.lit("e"), key, F.lit("@x.org")).alias("email"),
        F.concat(F.lit("123-45-"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("ssn"),
        F.col("c_mktsegment").alias("department"), F.col("n_name").alias("site"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key % 9000).cast("int")).alias("hire_date"))


def pay(spark, d) -> DataFrame:
    return load(spark, d, "customer").filter("c_acctbal > -500").select(
        F.col("c_custkey").alias("employee_id"), (F.floor("c_acctbal") + 50000).cast("double").alias("base_salary"),
        (F.col("c_custkey") % 7 * 100).cast("double").alias("bonus"), (F.col("c_custkey") % 50).alias("stock_options"),
        F.lit("2023-04-01").cast("date").alias("effective_date"))


def reviews(spark, d) -> DataFrame:
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("employee_id"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("rating"),
        F.col("o_orderdate").alias("review_date"))


def cases(spark, d) -> DataFrame:
    """At most one open case per employee."""
    return load(spark, d, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("employee_id"), F.concat(F.lit("CASE-"), "c_custkey").alias("case_id"),
        F.lit("open").alias("status"))


_PEOPLE = """(SELECT c_custkey AS employee_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
  'e' || c_custkey || '@x.org' AS email, '123-45-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ssn, c_mktsegment AS department,
  n_name AS site, DATE '1995-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS hire_date FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_PAY = """(SELECT c_custkey AS employee_id, CAST(floor(c_acctbal) + 50000 AS DOUBLE) AS base_salary, CAST(c_custkey % 7 * 100 AS DOUBLE) AS bonus,
  c_custkey % 50 AS stock_options, DATE '2023-04-01' AS effective_date FROM customer WHERE c_acctbal > -500)"""
_REVIEWS = "(SELECT o_custkey AS employee_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS rating, o_orderdate AS review_date FROM orders)"
_ANALYST = f"""SELECT 'EMP_' || lpad(CAST(p.employee_id AS VARCHAR), greatest(6, length(CAST(p.employee_id AS VARCHAR)))::INTEGER, '0') AS anonymous_id, department,
  CAST(year(hire_date) AS INTEGER) AS hire_year, base_salary, bonus, stock_options, CAST(year(effective_date) AS INTEGER) AS comp_year, rating,
  CAST(quarter(review_date) AS INTEGER) AS review_quarter, CAST(year(review_date) AS INTEGER) AS review_year
  FROM {_PEOPLE} p LEFT JOIN {_PAY} c ON p.employee_id = c.employee_id LEFT JOIN {_REVIEWS} r ON p.employee_id = r.employee_id
  WHERE department <> 'BUILDING'"""


def analyst(spark, d) -> DataFrame:
    return gov.analyst_view(employees(spark, d), pay(spark, d), reviews(spark, d), EXCLUDED)


@query("analyst_view", _ANALYST)
def analyst_view(spark, d) -> DataFrame:
    return analyst(spark, d)


@query("admin_view", f"""
  SELECT p.* EXCLUDE (hire_date), CAST(hire_date AS VARCHAR) AS hire_date, base_salary, bonus, stock_options, rating, review_date,
    CASE WHEN c_acctbal < 0 THEN 'CASE-' || c_custkey END AS case_id, CASE WHEN c_acctbal < 0 THEN 'open' END AS status
  FROM {_PEOPLE} p LEFT JOIN {_PAY} c ON p.employee_id = c.employee_id LEFT JOIN {_REVIEWS} r ON p.employee_id = r.employee_id
  JOIN customer k ON p.employee_id = k.c_custkey""")
def admin_view(spark, d) -> DataFrame:
    view = gov.admin_view(employees(spark, d), pay(spark, d).drop("effective_date"), reviews(spark, d), cases(spark, d))
    return view.withColumn("hire_date", F.col("hire_date").cast("string"))


MASKS = {"ssn": gov.mask_tail(), "email": gov.redact()}


@query("mask_by_role", f"""
  SELECT 'admin' AS role, employee_id, ssn, email FROM {_PEOPLE}
  UNION ALL SELECT 'analyst', employee_id, '{MASK_FOR_ANALYSTS}', '***REDACTED***' FROM {_PEOPLE}
  UNION ALL SELECT 'other', employee_id, '{MASK_LEAD}' || right(ssn, 4), '***REDACTED***' FROM {_PEOPLE}""")
def mask_by_role(spark, d) -> DataFrame:
    people = employees(spark, d).select("employee_id", "ssn", "email")
    return gov.views_by_role(people, MASKS, ["admin", "analyst", "other"])


@query("sql_mask_function", f"""
  SELECT employee_id, '{MASK_LEAD}' || right(ssn, 4) AS by_default, '{MASK_FOR_ANALYSTS}' AS for_analyst, ssn AS for_admin FROM {_PEOPLE}""")
def sql_mask_function(spark, d) -> DataFrame:
    register_masks(spark)
    return employees(spark, d).selectExpr(
        "employee_id", "mask_value(ssn) AS by_default", "mask_value(ssn, 'analyst') AS for_analyst",
        "mask_value(ssn, 'admin') AS for_admin")


@query("analyze_performance", f"""
  SELECT department, avg(rating) AS avg_rating, min(rating) AS min_rating, max(rating) AS max_rating,
    count(DISTINCT anonymous_id) AS employee_count, avg({THIS_YEAR} - hire_year) AS avg_tenure_years
  FROM ({_ANALYST}) WHERE rating IS NOT NULL GROUP BY 1""")
def analyze_performance(spark, d) -> DataFrame:
    return gov.analyze_performance(analyst(spark, d), THIS_YEAR)


@query("analyze_operations", f"""
  SELECT department, count(DISTINCT anonymous_id) AS employee_count, avg(base_salary) AS avg_salary, avg(bonus) AS avg_bonus,
    avg(base_salary + bonus) AS avg_total_comp, avg(stock_options) AS avg_stock_options
  FROM ({_ANALYST}) WHERE base_salary IS NOT NULL GROUP BY 1""")
def analyze_operations(spark, d) -> DataFrame:
    return gov.analyze_operations(analyst(spark, d))
