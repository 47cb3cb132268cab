"""Usage audits and activity reports: an event is an access (workspace: type, user: user id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators import governance
from weir.operators.aggregates import top_per_group
from weir.registry import query
from weir.session import pinned, shared_dir
from weir.tables import load

AS_OF, DAYS = "2024-02-15", 30


@query("top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def top_users(spark, d) -> DataFrame:
    """Sorted inside each partition only: no global sort for a chart's input."""
    counts = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.sortWithinPartitions(F.desc("n"))


@query("top_user_per_workspace", """
  SELECT event_type, user_id, event_count FROM (
    SELECT event_type, user_id, count(*) AS event_count,
      dense_rank() OVER (PARTITION BY event_type ORDER BY count(*) DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def top_user_per_workspace(spark, d) -> DataFrame:
    return top_per_group(load(spark, d, "events"), ["event_type"], ["user_id"])


@query("active_users_by_period", """
  SELECT 'day' AS period, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(DISTINCT user_id) AS users FROM events GROUP BY 2
  UNION ALL SELECT 'month', CAST(date_trunc('month', ts) AS TIMESTAMP), count(DISTINCT user_id) FROM events GROUP BY 2""")
def active_users(spark, d) -> DataFrame:
    """The months are counted from the distinct (user, day) pairs, so events are read once per user and day."""
    daily = load(spark, d, "events").select("user_id", F.date_trunc("day", "ts").alias("day")).distinct()
    per = lambda name, start: daily.groupBy(start.alias("start")).agg(
        F.countDistinct("user_id").alias("users")).select(F.lit(name).alias("period"), "start", "users")
    return per("day", F.col("day")).unionAll(per("month", F.date_trunc("month", "day")))


def access_log(spark, d) -> DataFrame:
    return load(spark, d, "events").select(
        F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), "ts",
        F.concat(F.lit("table_"), F.pmod("event_id", F.lit(7))).alias("source_table"))


@query("usage_audit", f"""
  SELECT event_type AS entity_type, user_id AS entity_id, max(ts) AS last_accessed, count(*) AS reference_count,
    array_to_string(list_sort(list_distinct(list('table_' || (event_id % 7)))), ',') AS tables_used
  FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY GROUP BY 1, 2 ORDER BY 1, 3 DESC""")
def usage_audit(spark, d) -> DataFrame:
    seen = governance.usage_audit(access_log(spark, d), AS_OF, DAYS, ["entity_type", "entity_id"], "source_table", "ts")
    return seen.orderBy("entity_type", F.desc("last_accessed"))


@query("text_usage_scan", """
  SELECT doc_id, source, left(text, 500) AS preview FROM documents WHERE contains(lower(text), 'license')""")
def text_usage_scan(spark, d) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "source", "text")
    return governance.text_usage(docs, "text", "license").select("doc_id", "source", "preview")


CLASSES = {"customer": ("confidential", True), "orders": ("internal", False), "supplier": ("confidential", True)}


@query("classification_report", """
  SELECT 'customer' AS table_name, 'confidential' AS data_classification, 'true' AS contains_pii, 'true' AS governance_enabled, count(*) AS n_rows FROM customer
  UNION ALL SELECT 'orders', 'internal', 'false', 'true', count(*) FROM orders
  UNION ALL SELECT 'supplier', 'confidential', 'true', 'true', count(*) FROM supplier""")
def classification_report(spark, d) -> DataFrame:
    """Classified catalog tables over the given files, with their row counts."""
    tag = shared_dir(spark, "c").rsplit("-", 1)[1]
    names = {t: f"weir_{t}_{tag}" for t in CLASSES}
    counts = None
    for t, (level, pii) in CLASSES.items():
        spark.sql(f"CREATE TABLE {names[t]} USING parquet LOCATION '{d}/{t}.parquet'")
        governance.classify_table(spark, names[t], level, pii)
        n = load(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_t", F.lit(names[t]))
        counts = n if counts is None else counts.unionAll(n)
    found = governance.classifications(spark, list(names.values()))
    out = pinned(found.join(counts, found.table_name == counts._t).drop("_t"), "classes")
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")         # external: the files stay
    return out.withColumn("table_name", F.split_part("table_name", F.lit("_"), F.lit(2)))
