import pytest
from conftest import rows
from pyspark.sql import functions as F

from weir.operators.joins import one_to_many


@pytest.mark.parametrize("max_rows", [40, 10_000])
def test_hot_keys_join_like_a_left_join(spark, max_rows):
    one = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"))
    many = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 60).alias("k"), F.col("id").alias("b"))
    got = one_to_many(one, many, ["k"], max_rows)
    assert got.columns == ["k", "a", "b"]
    assert rows(got) == rows(one.join(many, "k", "left"))
