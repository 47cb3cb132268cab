"""Bookings with fraud flags: a booking is a document, a toxic label is a fraud flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators.aggregates import rate_pct
from weir.operators.sampling import hash_bucket, hash_sample
from weir.registry import query
from weir.tables import load


def with_fraud(spark, d) -> DataFrame:
    """Every booking with its optional flag (labels hold one row per document)."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    flags = load(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "fraud").alias("flag"), "quality")
    return docs.join(flags, "doc_id", "left").withColumn(
        "is_fraud", F.coalesce(F.col("flag") == "fraud", F.lit(False))).drop("flag")


@query("bookings_with_fraud", """
  SELECT d.doc_id, lang, source, n_chars, quality, CASE WHEN toxic = 1 THEN true ELSE false END AS is_fraud
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def bookings_with_fraud(spark, d) -> DataFrame:
    return with_fraud(spark, d)


@query("fraud_rate", """
  SELECT lang AS party, source AS payment_method, count(*) AS total_bookings,
         CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_count,
         round(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS fraud_rate_pct
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def fraud_rate(spark, d) -> DataFrame:
    return with_fraud(spark, d).groupBy(F.col("lang").alias("party"), F.col("source").alias("payment_method")).agg(
        F.count(F.lit(1)).alias("total_bookings"), F.count_if("is_fraud").alias("fraud_count"),
        rate_pct(F.col("is_fraud")).alias("fraud_rate_pct"))


_BUCKET = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4)) AS INTEGER)"
REVIEWERS = 4


@query("hash_sample_labels", f"""
  SELECT lang, {_BUCKET} % {REVIEWERS} AS reviewer, count(*) AS bookings, min(doc_id) AS first_booking
  FROM documents WHERE {_BUCKET} < 1966 GROUP BY 1, 2""")
def hash_sample_labels(spark, d) -> DataFrame:
    """A fixed 3 % of the bookings, dealt to reviewers by the same hash: the work list of each."""
    chosen = hash_sample(load(spark, d, "documents").select("doc_id", "lang"), "doc_id", 3.0)
    return chosen.groupBy("lang", (hash_bucket(F.col("doc_id")) % REVIEWERS).alias("reviewer")).agg(
        F.count(F.lit(1)).alias("bookings"), F.min("doc_id").alias("first_booking"))
