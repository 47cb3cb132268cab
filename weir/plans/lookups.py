"""Lookup functions as set-based jobs: one row per request, not one call per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.functions.numbers import total_amount
from weir.functions.sql_functions import register_shop
from weir.operators.cdc import latest_per_key
from weir.plans.documents import catalog
from weir.plans.loans import TREATMENTS, treatments
from weir.registry import query
from weir.tables import load


@query("latest_return", """
  SELECT CAST(o_orderdate AS DATE)::VARCHAR AS purchase_date, o_orderpriority AS issue_category, c_name AS name
  FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def latest_return(spark, d) -> DataFrame:
    last = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").orderBy(
        F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    return last.join(c, last.o_custkey == c.c_custkey).select(
        F.to_date("o_orderdate").cast("string").alias("purchase_date"),
        F.col("o_orderpriority").alias("issue_category"), F.col("c_name").alias("name"))


@query("order_history", """
  SELECT c_name AS name, o_orderpriority AS issue_category, count(*) AS returns, '2002-01-01' AS todays_date
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def order_history(spark, d, user_name: str | None = None, today: str = "2002-01-01") -> DataFrame:
    """Cases per category for one customer, or for all; counted by key before names are joined."""
    c = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    if user_name is not None:
        c = c.filter(F.col("name") == user_name)
    per = load(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("issue_category")).agg(
        F.count(F.lit(1)).alias("n"))
    return per.join(c, per.o_custkey == c.c_custkey).groupBy("name", "issue_category").agg(
        F.sum("n").alias("returns")).withColumn("todays_date", F.lit(today))


TERMS = ["ring", "Widget", "blue", "no such thing"]


@query("product_lookup", f"""
  WITH c AS (SELECT p_partkey, p_name, p_type, p_size, CASE WHEN p_size >= 40 THEN 'Discontinued' ELSE 'In Stock' END AS a FROM part)
  SELECT request, 'Product: ' || p_name || chr(10) || 'Category: ' || p_type || chr(10) || 'Price: $' || p_size || chr(10) || 'Availability: ' || a AS answer
  FROM (SELECT unnest({TERMS}) AS request) JOIN c ON contains(lower(p_name), lower(request))
  QUALIFY row_number() OVER (PARTITION BY request ORDER BY p_partkey) = 1""")
def product_lookup(spark, d, requests=TERMS) -> DataFrame:
    """The first product whose name contains each requested term.

    The few terms travel inside the expression: each product lists the terms it answers, a hash
    aggregate keeps the smallest number per term, and only those products are fetched.
    """
    asked, products = F.array(*[F.lit(r) for r in requests]), catalog(spark, d)
    hits = products.select("product_id", F.explode(F.filter(
        asked, lambda r: F.contains(F.lower("product_name"), F.lower(r)))).alias("request"))
    first = hits.groupBy("request").agg(F.min("product_id").alias("product_id"))
    answer = F.concat_ws(
        "\n", F.concat(F.lit("Product: "), "product_name"), F.concat(F.lit("Category: "), "category"),
        F.concat(F.lit("Price: $"), "price"), F.concat(F.lit("Availability: "), "availability"))
    return products.join(first, "product_id").select("request", answer.alias("answer"))


@query("order_status", """
  WITH o AS (SELECT *, 'Order: ORD-' || o_orderkey || chr(10) || 'Status: ' || o_orderstatus || chr(10) || 'Order date: ' || strftime(o_orderdate, '%Y-%m-%d') AS answer FROM orders)
  SELECT 'ORD-' || o_orderkey AS request, answer FROM o WHERE o_orderstatus = 'P'
  UNION ALL SELECT lower('Cust' || c_custkey || '@Shop.com') AS request, answer FROM customer JOIN o ON o_custkey = c_custkey
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) = 1""")
def order_status(spark, d) -> DataFrame:
    """Requests by order id (all pending orders) and by e-mail (all customers, their newest order).

    One equality join per kind of identifier; the newest order per customer is found before the join.
    """
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    answer = F.concat_ws(
        "\n", F.concat(F.lit("Order: ORD-"), "o_orderkey"), F.concat(F.lit("Status: "), "o_orderstatus"),
        F.concat(F.lit("Order date: "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("answer")
    by_id = orders.select(F.concat(F.lit("ORD-"), "o_orderkey").alias("request"), answer, "o_orderstatus").filter(
        "o_orderstatus = 'P'").drop("o_orderstatus")
    newest = latest_per_key(orders, ["o_custkey"], ["o_orderkey"])
    c = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("Cust"), "c_custkey", F.lit("@Shop.com")).alias("email"))
    by_mail = c.join(newest, c.c_custkey == newest.o_custkey).select(F.lower("email").alias("request"), answer)
    return by_id.unionAll(by_mail)


@query("policy_concat", """
  WITH p AS (SELECT o_orderpriority AS policy, o_orderstatus || ' orders: ' || count(*) AS details FROM orders GROUP BY o_orderpriority, o_orderstatus)
  SELECT string_agg(policy || ': ' || details, chr(10) || chr(10) ORDER BY policy || ': ' || details) AS policy_text FROM p""")
def policy_concat(spark, d, topic: str | None = None) -> DataFrame:
    """All policies, or those on a topic, as one text.  Policies are one row per priority and
    status code, counted before they are gathered, so the text stays short."""
    p = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("policy"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(
        "policy", F.concat("o_orderstatus", F.lit(" orders: "), "n").alias("details"))
    if topic is not None:
        p = p.filter(F.lower("policy").contains(topic.lower()) | F.lower("details").contains(topic.lower()))
    line = F.concat("policy", F.lit(": "), "details")
    return p.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n\n").alias("policy_text"))


@query("franchise_by_city", """
  SELECT n_name AS city, s_suppkey AS franchise_id, s_name AS name, CASE WHEN s_acctbal > 5000 THEN 'L' ELSE 'S' END AS size
  FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY city, size DESC, franchise_id""")
def franchise_by_city(spark, d, city: str | None = None) -> DataFrame:
    s, n = load(spark, d, "supplier"), load(spark, d, "nation")
    if city is not None:
        n = n.filter(F.col("n_name") == city)
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("city"), F.col("s_suppkey").alias("franchise_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 5000, "L").otherwise("S").alias("size")).orderBy("city", F.desc("size"), "franchise_id")


@query("franchise_sales", """
  SELECT l_suppkey AS franchise_id, l_returnflag AS product, round(sum(l_extendedprice), 2) AS total_sales, CAST(sum(l_quantity) AS BIGINT) AS total_quantity
  FROM lineitem GROUP BY 1, 2""")
def franchise_sales(spark, d, franchise_id: int | None = None) -> DataFrame:
    lines = load(spark, d, "lineitem")
    if franchise_id is not None:
        lines = lines.filter(F.col("l_suppkey") == franchise_id)
    return lines.groupBy(F.col("l_suppkey").alias("franchise_id"), F.col("l_returnflag").alias("product")).agg(
        total_amount(F.col("l_extendedprice")).alias("total_sales"), F.sum("l_quantity").cast("long").alias("total_quantity"))


@query("sql_table_function", """
  SELECT s_suppkey AS franchise_id, s_name AS name, CASE WHEN s_acctbal > 5000 THEN 'L' ELSE 'S' END AS size, l_returnflag AS product,
    round(sum(l_extendedprice), 2) AS total_sales, CAST(sum(l_quantity) AS BIGINT) AS total_quantity
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL""")
def sql_table_function(spark, d) -> DataFrame:
    franchise_by_city(spark, d).createOrReplaceTempView("weir_franchises")
    load(spark, d, "lineitem").selectExpr(
        "l_suppkey AS franchise_id", "l_returnflag AS product", "l_extendedprice AS price", "l_quantity AS quantity",
    ).createOrReplaceTempView("weir_sales")
    register_shop(spark, "weir_franchises", "weir_sales")
    return spark.sql("SELECT s.franchise_id, s.name, s.size, t.* FROM shops_in() s, LATERAL sales_of(s.franchise_id) t")


@query("lookup_enrich", f"""
  SELECT c_custkey, accounting_treatment FROM customer JOIN (VALUES {', '.join(f"({i}, '{t}')" for i, t in TREATMENTS)}) AS r(id, accounting_treatment)
  ON c_nationkey % 6 = id""")
def lookup_enrich(spark, d) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 6).alias("id"))
    return c.join(treatments(spark), "id").drop("id")
