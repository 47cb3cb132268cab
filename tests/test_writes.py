from conftest import rows
from pyspark.sql import functions as F

from weir.functions.sql_functions import register_masks, register_shop
from weir.operators import writes
from weir.plans import lookups
from weir.tables import load


def test_fill_once(spark):
    assert writes.fill_if_empty(spark, "filled_once", spark.range(3))
    assert not writes.fill_if_empty(spark, "filled_once", spark.range(9))
    assert spark.table("filled_once").count() == 3


def test_replace_changes_the_schema(spark):
    writes.replace_table(spark.range(3), "replaced")
    writes.replace_table(spark.range(3).withColumn("b", F.lit("x")), "replaced", "id", 2)
    assert spark.table("replaced").columns == ["id", "b"]


def test_evolving_append(spark, tmp_path):
    path = str(tmp_path / "t")
    writes.append_evolving(spark.range(1), path)
    writes.append_evolving(spark.range(1, 2).withColumn("b", F.lit("x")), path)
    assert rows(writes.read_evolved(spark, path)) == [(0, None), (1, "x")]


def test_clustered_table_prunes_partitions(spark, data, tmp_path):
    path = str(tmp_path / "t")
    events = load(spark, data, "events").withColumn("date", F.to_date("ts"))
    writes.write_clustered(events, path, "date", ["user_id", "ts"])
    some = spark.read.parquet(path).filter("date = '2024-01-05'")
    assert some.count() == events.filter("date = '2024-01-05'").count()
    assert "PartitionFilters: [isnotnull(date" in some._jdf.queryExecution().toString()


def test_sql_functions(spark, data):
    register_masks(spark)
    got = spark.sql("SELECT mask_value('123-45-6789'), mask_value('x', 'admin'), mask_value('x', 'analyst')").first()
    assert tuple(got) == ("***-**-6789", "x", "ANALYTICS_MASKED")
    lookups.sql_table_function(spark, data)
    city = lookups.franchise_by_city(spark, data).first().city
    named = spark.sql(f"SELECT franchise_id FROM shops_in('{city}')")
    assert rows(named) == rows(lookups.franchise_by_city(spark, data, city), "franchise_id")
    sold = spark.sql("SELECT * FROM sales_of(1)")
    assert rows(sold) == rows(lookups.franchise_sales(spark, data, 1), "product", "total_sales", "total_quantity")
    register_shop(spark, "weir_franchises", "weir_sales")


def test_xml_schema_of_a_sample(spark):
    text = "<a><b>1</b><c>x</c></a>"
    assert spark.range(1).select(F.schema_of_xml(F.lit(text))).first()[0] == "STRUCT<b: BIGINT, c: STRING>"


def test_every_row_is_scored(spark):
    from weir.operators import models

    rows = spark.createDataFrame([(float(i % 7) if i % 4 else None, float(i % 2)) for i in range(200)], "x double, y double")
    means = models.training_means(rows, ["x"])
    model = models.fit_regressor(models.without_gaps(rows, ["x"], means), ["x"], "y", trees=2, depth=2)
    assert models.score(model, models.without_gaps(rows, ["x"], means)).count() == 200


def test_append_adds_columns(spark):
    from weir.operators.writes import append_table, replace_table

    replace_table(spark.createDataFrame([(1, "a")], "id int, name string"), "grown")
    append_table(spark.createDataFrame([(True, 2)], "flag boolean, id int"), "grown")
    got = sorted(map(tuple, spark.table("grown").collect()))
    spark.sql("DROP TABLE grown")
    assert got == [(1, "a", None), (2, None, True)]
