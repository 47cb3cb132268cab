"""SQL functions for analysts: scalar, with an optional parameter, and table-valued.

Bodies are plain SQL, so the planner inlines them; nothing runs per row outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from weir.functions.fixed_values import MASK_FOR_ANALYSTS, MASK_LEAD


def register_masks(spark: SparkSession) -> None:
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION mask_value(
          clear STRING COMMENT 'the value to protect',
          role STRING DEFAULT 'other' COMMENT 'admin, analyst or anything else')
        RETURNS STRING
        COMMENT 'admin: clear, analyst: a constant, others: the last four characters'
        RETURN CASE role WHEN 'admin' THEN clear WHEN 'analyst' THEN '{MASK_FOR_ANALYSTS}'
               ELSE concat('{MASK_LEAD}', right(clear, 4)) END""")


def register_shop(spark: SparkSession, franchises: str, sales: str) -> None:
    """Table functions over two views: ``franchises(city, franchise_id, name, size)`` and
    ``sales(franchise_id, product, price, quantity)``."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION shops_in(
          wanted STRING DEFAULT NULL COMMENT 'city to look in, all cities if left out')
        RETURNS TABLE (franchise_id BIGINT, name STRING, size STRING)
        RETURN SELECT franchise_id, name, size FROM {franchises} WHERE wanted IS NULL OR city = wanted""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION sales_of(wanted BIGINT COMMENT 'franchise')
        RETURNS TABLE (product STRING, total_sales DOUBLE, total_quantity BIGINT)
        RETURN SELECT product, sum(CAST(rint(price * 100) AS BIGINT)) / 100, CAST(sum(quantity) AS BIGINT)
               FROM {sales} WHERE franchise_id = wanted GROUP BY product""")
