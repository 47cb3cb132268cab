"""Quality rules over the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators import quality
from weir.operators.quality import Rule
from weir.registry import query
from weir.tables import load

RULES = [
    Rule("recent", "o_orderdate >= TIMESTAMP_NTZ '1996-01-01'"),
    Rule("worth it", "o_totalprice > 5000", "drop"),
    Rule("not pending", "nullif(o_orderstatus, 'P') IN ('F', 'O')", "drop"),
    Rule("key set", "o_orderkey IS NOT NULL", "fail"),
]
_KEEP = "o_totalprice > 5000 AND o_orderstatus IN ('F', 'O')"


@query("expect_metrics", """
  WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1996-01-01') AS a,
    count(*) FILTER (WHERE o_totalprice > 5000) AS b, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS c,
    count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS e FROM orders)
  SELECT 'recent' AS rule, 'log' AS action, a AS passed, n - a AS failed FROM t
  UNION ALL SELECT 'worth it', 'drop', b, n - b FROM t UNION ALL SELECT 'not pending', 'drop', c, n - c FROM t
  UNION ALL SELECT 'key set', 'fail', e, n - e FROM t""")
def expect_metrics(spark, d) -> DataFrame:
    return quality.metrics(load(spark, d, "orders"), RULES)


@query("expect_drop", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 5000")
def expect_drop(spark, d) -> DataFrame:
    return quality.clean(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), [RULES[1]])


@query("expect_fail", "SELECT o_orderkey, o_custkey FROM orders")
def expect_fail(spark, d) -> DataFrame:
    """Passes the rows on while no row breaks the rule; the first one that does stops the job."""
    return quality.clean(load(spark, d, "orders").select("o_orderkey", "o_custkey"), [RULES[3]])


@query("expect_mixed", f"SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders WHERE {_KEEP}")
def expect_mixed(spark, d) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return quality.clean(rows, RULES)


@query("quarantine", f"""
  SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_orderdate >= TIMESTAMP '1996-01-01' THEN 'recent' END,
    CASE WHEN NOT o_totalprice > 5000 THEN 'worth it' END,
    CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'not pending' END) AS failed_rules
  FROM orders WHERE NOT ({_KEEP})""")
def quarantine(spark, d) -> DataFrame:
    bad = quality.quarantine(load(spark, d, "orders"), RULES)
    return bad.select("o_orderkey", F.array_join("failed_rules", ",").alias("failed_rules"))
