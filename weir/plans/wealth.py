"""Bank and investment customers: investments are orders, campaigns come from the segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import total_amount
from weir.functions.fixed_values import WEALTH_OTHERS, WEALTH_SEGMENTS
from weir.operators.joins import one_to_many
from weir.operators.quality import Rule, clean
from weir.registry import query
from weir.tables import load

TX_PARTS = 20        # a bank transaction is this part of an order's price, in whole units


def net_worth_of(portfolio: DataFrame) -> DataFrame:
    """Portfolio value per customer; also the streaming aggregate (update mode)."""
    kept = clean(portfolio, [Rule("customer_set", "customer_id IS NOT NULL", "drop")])
    return kept.groupBy("customer_id").agg(total_amount(F.col("portfolio_value")).alias("total_net_worth"))


def portfolio(spark, d) -> DataFrame:
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("portfolio_value"))


def bank_summary(spark, d) -> DataFrame:
    tx = load(spark, d, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.floor(F.col("o_totalprice") / TX_PARTS).cast("double").alias("amount"))
    return tx.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("num_transactions"), F.max("amount").alias("max_amount"),
        F.avg("amount").alias("avg_amount"))


def bank_customers(spark, d) -> DataFrame:
    return load(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("customer_id"))


def campaigns(spark, d) -> DataFrame:
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("campaign_name"))


_NW = "SELECT o_custkey AS customer_id, round(sum(o_totalprice), 2) AS total_net_worth FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1"
_BANK = f"""SELECT o_custkey AS customer_id, count(*) AS num_transactions, max(CAST(floor(o_totalprice / {TX_PARTS}) AS DOUBLE)) AS max_amount,
  avg(CAST(floor(o_totalprice / {TX_PARTS}) AS DOUBLE)) AS avg_amount FROM orders GROUP BY 1"""


@query("net_worth", _NW)
def net_worth(spark, d) -> DataFrame:
    return net_worth_of(portfolio(spark, d))


@query("banking_summary", _BANK)
def banking_summary(spark, d) -> DataFrame:
    return bank_summary(spark, d)


def wealth_segment(worth):
    label = None
    for least, name in WEALTH_SEGMENTS:
        label = F.when(worth > least, name) if label is None else label.when(worth > least, name)
    return label.otherwise(WEALTH_OTHERS)


# --- fixed values: limits and shares of the offers ------------------------------------------
RICH = 500_000
REVENUE_SHARE = 0.015
LEAST_CASH, LEAST_WORTH = 2_000, 5_000
INVEST_SHARE, FREE_SHARE = 0.3, 0.1


@query("net_worth_segments", f"""
  SELECT nw.customer_id, total_net_worth,
    CASE {' '.join(f"WHEN total_net_worth > {least} THEN '{label}'" for least, label in WEALTH_SEGMENTS)} ELSE '{WEALTH_OTHERS}' END AS wealth_segment,
    round(total_net_worth * CAST({REVENUE_SHARE} AS DOUBLE), 0) AS revenue_opportunity, c.c_mktsegment AS campaign_name
  FROM ({_NW}) nw LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) b ON nw.customer_id = b.c_custkey
  LEFT JOIN customer c ON nw.customer_id = c.c_custkey
  WHERE b.c_custkey IS NULL AND total_net_worth > {RICH}""")
def investment_only(spark, d) -> DataFrame:
    """Investors who do not bank here (anti join), with the campaigns they are in."""
    rich = net_worth_of(portfolio(spark, d)).filter(F.col("total_net_worth") > RICH)
    prospects = rich.join(bank_customers(spark, d), "customer_id", "left_anti")
    return one_to_many(prospects, campaigns(spark, d), ["customer_id"]).select(
        "customer_id", "total_net_worth", wealth_segment(F.col("total_net_worth")).alias("wealth_segment"),
        F.round(F.col("total_net_worth") * REVENUE_SHARE, 0).alias("revenue_opportunity"), "campaign_name")


CASH_HEAVY, CASH_POOR = 0.006, 0.004      # cash to investments, fitted to the order prices

# --- fixed values: advice texts ------------------------------------------------------------
CASH_HEAVY_ADVICE = "Too Much Cash - Suggest Investment"
CASH_POOR_ADVICE = "Cash Poor - Suggest Liquidity Products"
BALANCED_ADVICE = "Balanced Portfolio"


@query("rebalancing", f"""
  SELECT b.customer_id, sum(avg_amount) AS cash_position, round(sum(total_net_worth), 2) AS investment_position,
    round(sum(avg_amount) / (sum(avg_amount) + sum(total_net_worth)) * 100, 1) AS cash_percentage,
    CASE WHEN sum(avg_amount) > sum(total_net_worth) * CAST({CASH_HEAVY} AS DOUBLE) THEN '{CASH_HEAVY_ADVICE}'
         WHEN sum(avg_amount) < sum(total_net_worth) * CAST({CASH_POOR} AS DOUBLE) THEN '{CASH_POOR_ADVICE}'
         ELSE '{BALANCED_ADVICE}' END AS recommendation,
    CASE WHEN sum(avg_amount) > sum(total_net_worth) * CAST({CASH_HEAVY} AS DOUBLE) THEN sum(avg_amount) * CAST({INVEST_SHARE} AS DOUBLE)
         WHEN sum(avg_amount) < sum(total_net_worth) * CAST({CASH_POOR} AS DOUBLE) THEN round(sum(total_net_worth), 2) * CAST({FREE_SHARE} AS DOUBLE)
         ELSE 0 END AS suggested_amount, c_mktsegment AS campaign_name
  FROM ({_BANK}) b JOIN ({_NW}) nw ON b.customer_id = nw.customer_id JOIN customer c ON b.customer_id = c.c_custkey
  WHERE avg_amount > {LEAST_CASH} AND total_net_worth > {LEAST_WORTH} GROUP BY b.customer_id, c_mktsegment""")
def rebalancing(spark, d) -> DataFrame:
    """Cash against investments per customer and campaign.

    Both summaries are keyed by customer, so one shuffle of the orders per summary is all
    that the joins and the final grouping need.
    """
    cash = bank_summary(spark, d).filter(F.col("avg_amount") > LEAST_CASH).select("customer_id", "avg_amount")
    worth = net_worth_of(portfolio(spark, d)).filter(F.col("total_net_worth") > LEAST_WORTH)
    both = cash.join(worth, "customer_id").join(campaigns(spark, d), "customer_id")
    per = both.groupBy("customer_id", "campaign_name").agg(
        F.sum("avg_amount").alias("_cash"), F.sum("total_net_worth").alias("_inv"))
    heavy, poor = F.col("_cash") > F.col("_inv") * CASH_HEAVY, F.col("_cash") < F.col("_inv") * CASH_POOR
    return per.select(
        "customer_id", F.col("_cash").alias("cash_position"), F.round("_inv", 2).alias("investment_position"),
        F.round(F.col("_cash") / (F.col("_cash") + F.col("_inv")) * 100, 1).alias("cash_percentage"),
        F.when(heavy, CASH_HEAVY_ADVICE).when(poor, CASH_POOR_ADVICE).otherwise(BALANCED_ADVICE).alias("recommendation"),
        F.when(heavy, F.col("_cash") * INVEST_SHARE).when(poor, F.round("_inv", 2) * FREE_SHARE).otherwise(0.0).alias("suggested_amount"),
        "campaign_name")


@query("overlap_count", f"""
  SELECT count(*) AS n FROM ({_BANK}) b JOIN ({_NW}) nw ON b.customer_id = nw.customer_id""")
def overlap_count(spark, d) -> DataFrame:
    return bank_summary(spark, d).join(net_worth_of(portfolio(spark, d)), "customer_id").agg(
        F.count(F.lit(1)).alias("n"))
