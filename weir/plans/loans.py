"""Loan balances: new transactions are orders, historical loans are order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import cents, total_amount
from weir.operators.quality import Rule, clean
from weir.registry import query
from weir.tables import literal_table, load

TREATMENTS = [(0, "held for trading"), (1, "amortised cost"), (2, "fair value through profit"),
              (3, "fair value through equity"), (4, "lower of cost or market"), (5, "off balance")]
_TREATMENT_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in TREATMENTS) + ") AS ref(id, accounting_treatment)"

CLEAN_RULES = [
    Rule("payments after 1995", "o_orderdate > TIMESTAMP_NTZ '1995-12-31'"),
    Rule("balance positive", "balance > 1000 AND arrears > 0", "drop"),
    Rule("cost center set", "cost_center_code IS NOT NULL", "fail"),
]


def treatments(spark) -> DataFrame:
    return literal_table(spark, TREATMENTS, "id INT, accounting_treatment STRING")


def enrich(tx: DataFrame, ref: DataFrame, code) -> DataFrame:
    """Transactions with the name of their accounting treatment (works on streams too)."""
    return tx.withColumn("_code", code).join(ref, F.col("_code") == F.col("id")).drop("_code", "id")


def new_transactions(spark, d) -> DataFrame:
    tx = load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("cost_center_code"),
        F.col("o_totalprice").alias("balance"), (F.col("o_totalprice") - 20000).alias("arrears"))
    return enrich(tx, treatments(spark), F.left("cost_center_code", F.lit(1)).cast("int"))


_NEW_SQL = f"""
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS cost_center_code, o_totalprice AS balance,
         o_totalprice - 20000 AS arrears, accounting_treatment
  FROM orders JOIN {_TREATMENT_SQL} ON CAST(o_orderpriority[1] AS INTEGER) = ref.id"""
_CLEAN_SQL = f"SELECT * FROM ({_NEW_SQL}) WHERE balance > 1000 AND arrears > 0"


@query("loan_enrich", _NEW_SQL)
def loan_enrich(spark, d) -> DataFrame:
    return new_transactions(spark, d)


def cleaned(spark, d) -> DataFrame:
    return clean(new_transactions(spark, d), CLEAN_RULES)


def historical(spark, d) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return enrich(lines, treatments(spark), F.col("l_linenumber") % 6)


@query("loan_historical_enrich", f"""
  SELECT accounting_treatment, count(*) AS n, round(sum(l_extendedprice), 2) AS bal
  FROM lineitem JOIN {_TREATMENT_SQL} ON l_linenumber % 6 = ref.id GROUP BY 1""")
def loan_historical_enrich(spark, d) -> DataFrame:
    return historical(spark, d).groupBy("accounting_treatment").agg(
        F.count(F.lit(1)).alias("n"), total_amount(F.col("l_extendedprice")).alias("bal"))


@query("loan_gold_by_cost_center", f"""
  SELECT cost_center_code, round(sum(balance), 2) AS sum_balance FROM ({_CLEAN_SQL}) GROUP BY 1""")
def by_cost_center(spark, d) -> DataFrame:
    return cleaned(spark, d).groupBy("cost_center_code").agg(total_amount(F.col("balance")).alias("sum_balance"))


def customer_country(spark, d) -> DataFrame:
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("country_code"))


@query("loan_gold_by_country", f"""
  SELECT n_name AS country_code, count(*) AS sum_count
  FROM ({_CLEAN_SQL}) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def by_country(spark, d) -> DataFrame:
    """Counted per customer first, so that a customer's rows meet its country once."""
    per_customer = cleaned(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    place = customer_country(spark, d)
    return per_customer.join(place, per_customer.o_custkey == place.c_custkey).groupBy("country_code").agg(
        F.sum("n").alias("sum_count"))


@query("loan_gold_union", f"""
  SELECT round(sum(l_extendedprice), 2) AS bal, n_name AS location_code
  FROM lineitem JOIN {_TREATMENT_SQL} ON l_linenumber % 6 = ref.id
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
  UNION
  SELECT round(sum(balance), 2) AS bal, n_name AS location_code
  FROM ({_CLEAN_SQL}) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def balances_everywhere(spark, d) -> DataFrame:
    per_branch = historical(spark, d).groupBy("l_suppkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("b"))
    s, n = load(spark, d, "supplier"), load(spark, d, "nation")
    branch = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("location_code"))
    old = per_branch.join(branch, per_branch.l_suppkey == branch.s_suppkey).groupBy("location_code").agg(
        (F.sum("b") / 100).alias("bal"))
    per_customer = cleaned(spark, d).groupBy("o_custkey").agg(F.sum(cents(F.col("balance"))).alias("b"))
    place = customer_country(spark, d)
    new = per_customer.join(place, per_customer.o_custkey == place.c_custkey).groupBy(
        F.col("country_code").alias("location_code")).agg((F.sum("b") / 100).alias("bal"))
    return old.select("bal", "location_code").union(new.select("bal", "location_code")).distinct()
