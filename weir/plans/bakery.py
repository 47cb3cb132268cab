"""Shop sales: transactions are order lines, franchises are suppliers, ingredients are parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import cents, total_amount
from weir.operators.aggregates import busiest, histogram, mean_of_group_sums, share_of_total
from weir.operators.quality import Rule, clean
from weir.registry import query
from weir.session import pinned
from weir.tables import load

FLAGSHIP_RULES = [
    Rule("supplier_set", "supplier_id IS NOT NULL", "fail"),
    Rule("correct_city", "city <> 'NATION_0'"),
]
STATS_RULES = [
    Rule("reasonable_avg_value", "avg_txn_value BETWEEN 1 AND 1000"),
    Rule("nonneg_revenue", "gross_revenue >= 0", "drop"),
    Rule("known_product", "product IS NOT NULL", "fail"),
]


def franchises(spark, d) -> DataFrame:
    s, n, r = (load(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").alias("franchise_id"), F.col("s_name").alias("name"),
        F.col("n_name").alias("city"), F.col("r_name").alias("country"),
        F.col("s_suppkey").alias("supplier_id"))


def ingredients(spark, d) -> DataFrame:
    named = F.when(F.col("p_size") > 5, F.col("p_name"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("supplier_id"), named.alias("ingredient"))


def flagship_sales(spark, d) -> DataFrame:
    """Sales per franchise on the latest day.  The day filter reaches the orders scan, and
    sales are summed per franchise before its attributes are joined."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    last_day = orders.agg(F.max("o_orderdate").alias("m")).select(F.date_trunc("day", "m").cast("timestamp_ntz")).scalar()
    latest = orders.filter(F.col("o_orderdate") >= last_day)
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    sales = lines.join(latest, lines.l_orderkey == latest.o_orderkey).groupBy("l_suppkey").agg(
        F.sum("l_extendedprice").alias("total_sales"))
    f = franchises(spark, d)
    per_place = sales.join(f, sales.l_suppkey == f.franchise_id).groupBy(
        "name", "city", "country", "supplier_id").agg(total_amount(F.col("total_sales")).alias("total_sales"))
    return clean(per_place, FLAGSHIP_RULES)


_FLAGSHIP_SQL = """
  SELECT s_name AS name, n_name AS city, r_name AS country, s_suppkey AS supplier_id,
         round(sum(l_extendedprice), 2) AS total_sales
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)
  GROUP BY ALL"""

query("gourmet_flagship_latest_day", _FLAGSHIP_SQL)(flagship_sales)


@query("gourmet_top5", f"""
  WITH f AS ({_FLAGSHIP_SQL}),
  p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name END AS ingredient FROM part)
  SELECT total_sales, name, city, country, ingredient
  FROM f LEFT JOIN p ON f.supplier_id = p.p_partkey WHERE ingredient IS NOT NULL
  ORDER BY total_sales DESC, name LIMIT 5""")
def top_five(spark, d) -> DataFrame:
    sales, parts = flagship_sales(spark, d), ingredients(spark, d)
    found = sales.join(parts, "supplier_id", "left").filter("ingredient IS NOT NULL")
    return found.select("total_sales", "name", "city", "country", "ingredient").orderBy(
        F.desc("total_sales"), "name").limit(5)


@query("sales_stats", """
  SELECT p_name AS product, count(*) AS txn_count, CAST(sum(l_quantity) AS BIGINT) AS units_sold,
         round(sum(l_extendedprice), 2) AS gross_revenue, CAST((2 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS avg_txn_value,
         count(DISTINCT o_custkey) AS unique_customers, count(DISTINCT l_suppkey) AS franchises_selling
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY p_name HAVING round(sum(l_extendedprice), 2) >= 0""")
def sales_stats(spark, d) -> DataFrame:
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    part = load(spark, d, "part").select("p_partkey", "p_name")
    sold = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    # joined once and stored by part, customer and shop; both distinct counts start from there, names come last
    base = pinned(sold.groupBy("l_partkey", "o_custkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("units"), F.sum(cents(F.col("l_extendedprice"))).alias("cents")), "sold")
    by_customer = base.groupBy("l_partkey", "o_custkey").agg(*[F.sum(c).alias(c) for c in ("n", "units", "cents")])
    by_shop = base.select("l_partkey", "l_suppkey").distinct()
    named = lambda rows: rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    customers = named(by_customer).groupBy("p_name", "o_custkey").agg(*[F.sum(c).alias(c) for c in ("n", "units", "cents")])
    totals = customers.groupBy(F.col("p_name").alias("product")).agg(
        F.sum("n").alias("txn_count"), F.sum("units").cast("long").alias("units_sold"),
        (F.sum("cents") / 100).alias("gross_revenue"), F.round(F.sum("cents") / F.sum("n") / 100, 2).alias("avg_txn_value"),
        F.count("o_custkey").alias("unique_customers"))
    shops = named(by_shop).select("p_name", "l_suppkey").distinct().groupBy(F.col("p_name").alias("product")).agg(
        F.count("l_suppkey").alias("franchises_selling"))
    return clean(totals.join(shops, "product"), STATS_RULES)


@query("weekly_units", """
  SELECT s_name AS franchise_name, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week,
         CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def weekly_units(spark, d) -> DataFrame:
    """Summed per franchise key and week first; only those sums meet the names."""
    per_week = load(spark, d, "lineitem").groupBy(
        "l_suppkey", F.date_trunc("week", "l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("q"))
    names = load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("franchise_name"))
    return per_week.join(names, per_week.l_suppkey == names.s_suppkey).groupBy("franchise_name", "week").agg(
        F.sum("q").cast("long").alias("quantity"))


@query("product_top_city", """
  SELECT n_name AS city, CAST(sum(l_quantity) AS BIGINT) AS units
  FROM lineitem JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
  WHERE p_type = 'PROMO' AND n_name IS NOT NULL GROUP BY 1 ORDER BY units DESC, city""")
def product_top_city(spark, d, product: str = "PROMO") -> DataFrame:
    wanted = load(spark, d, "part").filter(F.col("p_type") == product).select("p_partkey")
    lines = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    per_shop = lines.join(wanted, lines.l_partkey == wanted.p_partkey, "left_semi").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("q"))
    shops = franchises(spark, d).select("franchise_id", "city")
    by_city = shops.join(per_shop, shops.franchise_id == per_shop.l_suppkey, "right").groupBy("city").agg(
        F.sum("q").cast("long").alias("units"))
    return by_city.filter("city IS NOT NULL").orderBy(F.desc("units"), "city")


@query("payment_share", """
  SELECT o_orderpriority AS payment_method, count(*) AS n,
         round(count(*) * 100.0 / (SELECT count(*) FROM orders), 1) AS share_pct
  FROM orders GROUP BY 1""")
def payment_share(spark, d) -> DataFrame:
    paid = load(spark, d, "orders").select(F.col("o_orderpriority").alias("payment_method"))
    return share_of_total(paid, "payment_method")


@query("peak_hour", """
  SELECT CAST(hour(ts) AS INTEGER) AS peak_hour, count(*) AS n FROM events
  GROUP BY 1 ORDER BY n DESC, peak_hour LIMIT 1""")
def peak_hour(spark, d) -> DataFrame:
    return busiest(load(spark, d, "events"), F.hour("ts"), "peak_hour")


@query("avg_basket", """
  SELECT round(avg(q), 4) AS avg_basket FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)""")
def avg_basket(spark, d) -> DataFrame:
    mean = mean_of_group_sums(load(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "m")
    return mean.select(F.round("m", 4).alias("avg_basket"))


@query("event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, d) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("value_histogram", """
  SELECT CAST(floor(value / 25) * 25 AS DOUBLE) AS bin_start, count(*) AS n FROM events GROUP BY 1""")
def value_histogram(spark, d) -> DataFrame:
    return histogram(load(spark, d, "events"), "value", 25)
