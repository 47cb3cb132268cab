"""Feature tables: daily sales per store (supplier) and product (part type), keys, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators import features as ft
from weir.operators.sampling import hash_split
from weir.registry import query
from weir.tables import load

SERIES = ["franchise_id", "product"]


def daily(spark, d) -> DataFrame:
    part = load(spark, d, "part").select("p_partkey", F.col("p_type").alias("product"))
    lines = load(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("franchise_id"), "l_shipdate", "l_quantity")
    return ft.daily_units(lines.join(part, lines.l_partkey == part.p_partkey), SERIES, "l_shipdate", "l_quantity")


_DAILY = """(SELECT l_suppkey AS franchise_id, p_type AS product, CAST(l_shipdate AS DATE) AS transaction_date, CAST(sum(l_quantity) AS BIGINT) AS units_sold
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
_LAGS = f"""SELECT *, lag(units_sold, 1) OVER w AS units_sold_d1, lag(units_sold, 2) OVER w AS units_sold_d2, lag(units_sold, 3) OVER w AS units_sold_d3,
  lag(units_sold, 7) OVER w AS units_sold_d7, avg(units_sold) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean_7d_units_sold,
  CAST(dayofweek(transaction_date) + 1 AS INTEGER) AS dow, lead(units_sold) OVER w AS target_units_sold
  FROM {_DAILY} WINDOW w AS (PARTITION BY franchise_id, product ORDER BY transaction_date)"""


@query("lag_features", f"""
  SELECT * EXCLUDE (transaction_date, mean_7d_units_sold), CAST(transaction_date AS VARCHAR) AS transaction_date, round(mean_7d_units_sold, 6) AS mean_7d_units_sold
  FROM ({_LAGS}) WHERE units_sold_d7 IS NOT NULL AND target_units_sold IS NOT NULL""")
def lags(spark, d) -> DataFrame:
    made = ft.lag_features(daily(spark, d), SERIES).dropna(subset=[*ft.lag_columns(), "dow", "target_units_sold"])
    return made.withColumns({
        "transaction_date": F.col("transaction_date").cast("string"), "mean_7d_units_sold": F.round("mean_7d_units_sold", 6)})


def filled(spark, d) -> DataFrame:
    made = ft.lag_features(daily(spark, d), SERIES)
    return ft.fill_with_group_mean(made, SERIES, ft.lag_columns()).dropna(
        subset=[*ft.lag_columns(), "dow", "target_units_sold"])


@query("lag_features_filled", f"""
  WITH l AS ({_LAGS}),
  f AS (SELECT franchise_id, product, CAST(transaction_date AS VARCHAR) AS transaction_date, units_sold, dow, target_units_sold,
    round(coalesce(units_sold_d1, avg(units_sold_d1) OVER p), 4) AS units_sold_d1, round(coalesce(units_sold_d2, avg(units_sold_d2) OVER p), 4) AS units_sold_d2,
    round(coalesce(units_sold_d3, avg(units_sold_d3) OVER p), 4) AS units_sold_d3, round(coalesce(units_sold_d7, avg(units_sold_d7) OVER p), 4) AS units_sold_d7,
    round(mean_7d_units_sold, 4) AS mean_7d_units_sold FROM l WINDOW p AS (PARTITION BY franchise_id, product))
  SELECT * FROM f WHERE units_sold_d7 IS NOT NULL AND target_units_sold IS NOT NULL""")
def lags_filled(spark, d) -> DataFrame:
    return filled(spark, d).withColumns({
        **{c: F.round(c, 4) for c in ft.lag_columns()}, "transaction_date": F.col("transaction_date").cast("string")})


@query("hash_split", """
  SELECT o_orderkey, CASE WHEN b < 52428 THEN 'train' WHEN b < 58982 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4)) AS INTEGER) AS b FROM orders)""")
def split_orders(spark, d) -> DataFrame:
    return hash_split(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "validation": 0.1, "test": 0.1})


def customer_features(spark, d) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_price")).withColumnRenamed("o_custkey", "c_custkey")


@query("feature_lookup", """
  SELECT c.c_custkey, c_mktsegment, n_orders, max_price FROM customer c LEFT JOIN
    (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price FROM orders GROUP BY 1) f ON c.c_custkey = f.o_custkey""")
def lookup(spark, d) -> DataFrame:
    facts = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ft.feature_lookup(facts, customer_features(spark, d), ["c_custkey"], ["n_orders", "max_price"])


@query("primary_key_check", """
  SELECT 'orders' AS table_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, 0::BIGINT AS null_key_rows
  FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
  UNION ALL SELECT 'lineitem', CAST(sum(n) AS BIGINT), count(*), count(*) FILTER (WHERE n > 1), 0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def key_checks(spark, d) -> DataFrame:
    one = lambda t, keys: ft.primary_key_check(load(spark, d, t), keys).select(F.lit(t).alias("table_name"), "*")
    return one("orders", ["o_orderkey"]).unionAll(one("lineitem", ["l_orderkey", "l_linenumber"]))


@query("loan_label_features", """
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'true' WHEN o_orderpriority = '5-LOW' THEN 'false' END AS bad_loan,
    CAST(o_custkey AS INTEGER) AS num_rev_accts, o_totalprice AS annual_inc, o_orderstatus AS grade
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def labelled(spark, d) -> DataFrame:
    """Ids are the orders' own keys: stable under retries, unlike generated ones."""
    bad, good = ["1-URGENT", "2-HIGH"], ["5-LOW"]
    return load(spark, d, "orders").filter(F.col("o_orderpriority").isin(bad + good)).select(
        F.col("o_orderkey").alias("id"), ft.binary_label("o_orderpriority", bad, good).alias("bad_loan"),
        F.col("o_custkey").cast("int").alias("num_rev_accts"), F.col("o_totalprice").cast("double").alias("annual_inc"),
        F.col("o_orderstatus").alias("grade")).dropna(subset=["num_rev_accts", "annual_inc", "grade"])


@query("impute_standardize", """
  WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer),
  f AS (SELECT c_custkey, coalesce(bal, (SELECT avg(bal) FROM t)) AS bal, nation FROM t)
  SELECT c_custkey, round((bal - (SELECT avg(bal) FROM f)) / (SELECT stddev_pop(bal) FROM f), 6) AS bal,
    round((nation - (SELECT avg(nation) FROM f)) / (SELECT stddev_pop(nation) FROM f), 6) AS nation FROM f""")
def standardized(spark, d) -> DataFrame:
    rows = load(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").alias("nation"))
    scaled = ft.fit_scaling(rows, ["bal", "nation"]).transform(rows)
    return scaled.withColumns({c: F.round(c, 6) for c in ("bal", "nation")})
