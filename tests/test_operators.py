"""Governance, geo, feature and report operators on small literal tables."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weir.functions.fixed_values import COUNTRY_CENTROIDS
from weir.functions.records import snake_case, snake_case_columns
from weir.operators import aggregates, devices, features, geo, governance, sampling
from weir.plans import lookups
from weir.plans.models import class_report, scored_documents
from weir.session import shared_dir


@pytest.mark.parametrize("role, want", [
    ("admin", ["123-45-6789", "89", None]), ("analyst", ["HIDDEN", "HIDDEN", "HIDDEN"]),
    ("guest", ["***-**-6789", "***-**-89", None])])
def test_masks(spark, role, want):
    df = spark.createDataFrame([(1, "123-45-6789"), (2, "89"), (3, None)], "id INT, ssn STRING")
    out = governance.mask_columns(df, {"ssn": governance.mask_tail("HIDDEN")}, role)
    assert [r.ssn for r in out.orderBy("id").collect()] == want


def test_redact(spark):
    df = spark.createDataFrame([("x@y",)], "mail STRING")
    assert governance.mask_columns(df, {"mail": governance.redact()}, "guest").first().mail == "***REDACTED***"


def test_pseudonyms_stay_distinct(spark):
    df = spark.createDataFrame([(12,), (12345678,), (12345679,)], "id INT")
    assert [r[0] for r in df.select(governance.padded_id("id")).collect()] == ["EMP_000012", "EMP_12345678", "EMP_12345679"]
    hidden = [r[0] for r in df.select(governance.salted_id("id", "s")).collect()]
    assert len(set(hidden)) == 3 and not any("12345" in h[4:12] for h in hidden[:1])


def test_small_groups_can_be_withheld(spark):
    view = spark.createDataFrame([("a", "E1", 3, 2000), ("a", "E2", 5, 2010), ("b", "E3", 1, 2020)], "department STRING, anonymous_id STRING, rating INT, hire_year INT")
    assert rows(governance.analyze_performance(view, 2024, min_group=2), "department", "avg_rating", "employee_count") == [("a", 4.0, 2)]


def test_classification(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS tagged USING parquet AS SELECT 1 AS x")
    governance.classify_table(spark, "tagged", "internal", False)
    assert tuple(governance.classifications(spark, ["tagged"]).first()) == ("tagged", "internal", "false", "true")


def test_snake_case(spark):
    assert [snake_case(n) for n in ("userName", "id", "accountUserId", "jobRunID", "HTTPPort2Use", "_x")] == [
        "user_name", "id", "account_user_id", "job_run_id", "http_port2_use", "_x"]
    df = spark.createDataFrame([(1, [(2, "x")])], "userId INT, subItems ARRAY<STRUCT<itemId: INT, note: STRING>>")
    out = snake_case_columns(df)
    assert out.select("sub_items.item_id").first()[0] == [2] and out.columns == ["user_id", "sub_items"]


def test_region_boxes_include_their_edges(spark):
    df = spark.createDataFrame([(35.0, -25.0), (72.0, 45.0), (34.9, 0.0), (-90.0, 0.0)], "latitude DOUBLE, longitude DOUBLE")
    assert geo.region_filter(df, "EUROPE").count() == 2
    assert {r.region for r in geo.with_regions(df.limit(1)).collect()} == {"EUROPE", "GLOBAL"}


def test_dead_reckoning(spark):
    df = spark.createDataFrame([(84.9, 10.0, 0.0, 200.0, 100.0, -1.0)], "latitude DOUBLE, longitude DOUBLE, heading DOUBLE, velocity DOUBLE, altitude DOUBLE, vertical_rate DOUBLE")
    pts = geo.dead_reckon(df).orderBy("point").collect()
    assert len(pts) == 41 and pts[0].track_lat == 84.9 and pts[-1].track_lat == 85.0
    assert pts[-1].track_alt == 0.0 and math.isclose(pts[-1].track_lon, 10.0)


def test_unknown_country_has_no_distance(spark):
    df = spark.createDataFrame([("Malta", 35.9, 15.4), ("Nowhere", 0.0, 0.0)], "origin_country STRING, latitude DOUBLE, longitude DOUBLE")
    assert [(r.origin_country, round(r.distance_deg, 6)) for r in geo.origin_distance(df, geo.centroids(spark)).collect()] == [("Malta", 1.0)]
    assert len({c for c, _, _ in COUNTRY_CENTROIDS}) == len(COUNTRY_CENTROIDS)


def test_altitude_and_airborne(spark):
    df = spark.createDataFrame([(None, 5.0, False, 11.0), (3.0, 5.0, True, 50.0), (None, None, False, 10.0)], "geo_altitude DOUBLE, baro_altitude DOUBLE, on_ground BOOLEAN, velocity DOUBLE")
    assert [tuple(r) for r in df.select(geo.altitude(), geo.airborne()).collect()] == [(5.0, True), (3.0, False), (0.0, False)]


def test_zero_is_no_position(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 3.0, 4.0), ("b", 9, None, 1.0)], "client_id STRING, timestamp INT, latitude DOUBLE, longitude DOUBLE")
    assert rows(devices.located(df), "timestamp") == [(2,)]
    stats = devices.client_totals(spark.createDataFrame([(True,), (False,)], "is_active BOOLEAN"))
    assert tuple(stats.first()) == (2, 1)


DAYS = "k STRING, transaction_date DATE, units_sold LONG"


def test_short_series_have_no_long_lags(spark):
    df = spark.sql("SELECT 'a' AS k, date_add(DATE '2024-01-01', CAST(id AS INT)) AS transaction_date, id AS units_sold FROM range(5) UNION ALL SELECT 'b', DATE '2024-01-01', 9")
    out = features.lag_features(df, ["k"])
    last = out.filter("k = 'a'").orderBy(F.desc("transaction_date")).first()
    assert (last.units_sold_d1, last.units_sold_d7, last.mean_7d_units_sold, last.target_units_sold) == (3, None, 2.0, None)
    assert out.filter("k = 'b'").first().mean_7d_units_sold == 9.0
    filled = features.fill_with_group_mean(out, ["k"], features.lag_columns())
    assert filled.filter("k = 'a' AND units_sold = 0").first().units_sold_d1 == 1.5
    assert filled.filter("k = 'a' AND units_sold = 0").first().units_sold_d7 is None


def test_primary_key_check_and_feature_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0)], "id INT, v DOUBLE")
    assert tuple(features.primary_key_check(df, ["id"]).first()) == (3, 2, 1, 1)
    assert tuple(features.primary_key_check(df.filter("v = 2"), ["id", "v"]).first()) == (1, 1, 0, 0)
    with pytest.raises(ValueError, match="is no key"):
        features.write_feature_table(df, str(tmp_path / "f"), ["id"])
    one, two = df.filter("v = 2"), spark.createDataFrame([(1, 9.0), (5, 5.0)], "id INT, v DOUBLE")
    features.write_feature_table(two, shared_dir(spark, "f") , ["id"])
    features.write_feature_table(two, str(tmp_path / "g"), ["id"], base=one)
    assert rows(spark.read.parquet(str(tmp_path / "g"))) == [(1, 9.0), (5, 5.0)]


def test_scaling_matches_numpy(spark):
    import numpy as np

    vals = [1.0, None, 4.0, "x", 10.0]
    df = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(vals)], "id INT, v STRING")
    got = [r.v for r in features.fit_scaling(df, ["v"]).transform(df).orderBy("id").collect()]
    a = np.array([1.0, 5.0, 4.0, 5.0, 10.0])
    assert np.allclose(got, (a - a.mean()) / a.std())


def test_constant_column_is_scaled_to_zero(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "v DOUBLE")
    assert [r.v for r in features.fit_scaling(df, ["v"]).transform(df).collect()] == [0.0, 0.0]


def test_label_without_else(spark):
    df = spark.createDataFrame([("Default",), ("Paid",), ("Current",)], "s STRING")
    assert [r[0] for r in df.select(features.binary_label("s", ["Default"], ["Paid"])).collect()] == ["true", "false", None]


def test_hash_sample_and_split_are_stable(spark):
    ids = spark.range(4000)
    picked = {r.id for r in sampling.hash_sample(ids, "id", 10).collect()}
    assert 300 < len(picked) < 500
    more = {r.id for r in sampling.hash_sample(spark.range(8000), "id", 10).collect()}
    assert picked == {i for i in more if i < 4000}
    parts = {r.split: r["count"] for r in sampling.hash_split(ids, "id", {"a": 8, "b": 1, "c": 1}).groupBy("split").count().collect()}
    assert sum(parts.values()) == 4000 and 3000 < parts["a"] < 3400


def test_ties_are_kept(spark):
    df = spark.createDataFrame([("w", "x"), ("w", "x"), ("w", "y"), ("w", "y"), ("w", "z")], "g STRING, m STRING")
    assert rows(aggregates.top_per_group(df, ["g"], ["m"])) == [("w", "x", 2), ("w", "y", 2)]


def test_shares_and_totals(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "c STRING")
    assert rows(aggregates.share_of_total(df, "c")) == [("a", 2, 66.7), ("b", 1, 33.3)]
    assert rows(aggregates.totals_and_breakdown(df, "c", "t", "n")) == [("n", "ALL", 3), ("n", "a", 2), ("n", "b", 1)]
    assert tuple(aggregates.busiest(df, F.col("c"), "v").first()) == ("a", 2)


def test_parameterised_lookups(spark, data):
    assert {r.city for r in lookups.franchise_by_city(spark, data, "NATION_3").collect()} <= {"NATION_3"}
    assert lookups.franchise_sales(spark, data, 1).select("franchise_id").distinct().collect()[0][0] == 1
    name = "Customer#000000005"
    assert {r.name for r in lookups.order_history(spark, data, name).collect()} <= {name}
    assert "1-URGENT" in lookups.policy_concat(spark, data, "urgent").first()[0]


def test_shared_dir_needs_a_cluster_setting(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError):
        shared_dir(Session(), "x")


def test_classes_are_compared_on_held_out_rows(spark, data):
    told = [("train", 1.0, 1.0), ("train", 1.0, 1.0), ("train", 0.0, 0.0), ("test", 1.0, 0.0), ("validation", 0.0, 0.0), ("unlabelled", None, 1.0)]
    report = class_report(spark.createDataFrame(told, "split string, quality double, prediction double"))
    assert {r.split: (r.rows, r.scored, r.no_worse_than_constant) for r in report.collect()} == {
        "train": (3, 3, True), "test": (1, 1, False), "validation": (1, 1, True), "unlabelled": (1, 1, True)}
    scored = scored_documents(spark, data)
    assert scored.columns == ["doc_id", "split", "quality", "prediction"]
    assert scored.filter("prediction IS NULL").count() == 0 and scored.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_f1_by_part_equals_the_evaluator(spark):
    from weir.operators import models

    rng = random.Random(4)
    data = [(rng.choice("ab"), float(rng.randint(0, 2)), float(rng.randint(0, 2))) for _ in range(80)] + [("a", None, 1.0), ("c", None, 1.0)]
    frame = spark.createDataFrame(data, "part string, label double, prediction double")
    got = {r.part: r.f1 for r in models.f1_by_part(frame, "part", "label", "prediction").collect()}
    assert got.keys() == {"a", "b"}
    for part in "ab":
        assert abs(got[part] - models.f1(frame.filter(f"part = '{part}' AND label IS NOT NULL"), "label")) < 1e-9


def test_training_rows_are_dealt_over_tasks(spark):
    from weir.operators import models

    one = spark.range(5_000).selectExpr("id", "id * 2 AS other").coalesce(1)
    dealt = models.in_tasks(one, ["id"], 5_000, 500)
    sizes = dealt.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert dealt.columns == ["id"] and len(sizes) == 10 and sum(sizes) == 5_000 and max(sizes) <= 550
    assert models.in_tasks(one, ["id"], 500, 500).rdd.getNumPartitions() == 1


def test_boosted_trees_are_those_of_spark(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from weir.operators import models

    rows = spark.range(3_000).select(*[((F.hash("id", F.lit(k)) % n) * 1.0).alias(c) for k, (c, n) in enumerate([("a", 16), ("b", 9), ("c", 3)])]).withColumn(
        "y", F.sin("a") * F.col("b") + F.when(F.col("a") > 3, F.col("c")).otherwise(-F.col("b")))
    for trees, depth, cols in ((6, 4, ["a", "b", "c"]), (2, 1, ["c"])):
        mine = models.fit_regressor(rows, cols, "y", trees, depth)
        theirs = Pipeline(stages=[
            VectorAssembler(inputCols=cols, outputCol="features"), GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth)]).fit(rows)
        ours = models.score(mine, rows).withColumnRenamed("prediction", "ours")
        assert theirs.transform(ours).filter("NOT abs(ours - prediction) < 1e-9").count() == 0
        assert mine.stages[1].totalNumNodes == theirs.stages[1].totalNumNodes
        assert abs(mine.stages[1].featureImportances.toArray() - theirs.stages[1].featureImportances.toArray()).max() < 1e-9


def test_training_rows_are_stored_packed(spark, monkeypatch):
    from weir.operators import boosting, models

    n, seen, grown = 200_000, [], boosting._grown

    def watched(blocks, *rest):
        tree = grown(blocks, *rest)
        stored = spark.sparkContext._jsc.sc().getRDDStorageInfo()
        seen.append((blocks.getNumPartitions(), max(x.memSize() + x.diskSize() for x in stored if x.id() == blocks._jrdd.id())))
        return tree

    monkeypatch.setattr(boosting, "_grown", watched)
    rows = spark.range(0, n, 1, 32).select(*[F.rand(k).alias(f"x{k}") for k in range(6)]).withColumn("y", F.col("x0") + F.col("x1"))
    models.fit_regressor(rows, [f"x{k}" for k in range(6)], "y", trees=3, depth=2)
    assert len(seen) == 3 and all(tasks <= spark.sparkContext.defaultParallelism and 0 < size < 20 * n for tasks, size in seen)
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_thresholds_come_from_all_rows(spark):
    from weir.operators import boosting

    n = 300_000
    rows = spark.range(0, n, 1, 5).select(
        F.pow(F.rand(1), 3).alias("many"), (F.col("id") % 7).cast("double").alias("few"), F.lit(2.0).alias("one"),
        F.when(F.col("id") == 5, 1.0).when(F.col("id") == 6, float("nan")).when(F.col("id") > 6, 0.0).alias("rare"), F.lit(0.0).alias("y"))
    total, (many, few, one, rare) = boosting.thresholds(rows, 32)
    assert total == n and few.tolist() == [k + 0.5 for k in range(6)] and one.tolist() == [] and rare.tolist() == [0.5]
    shares = rows.groupBy(sum((F.col("many") > float(e)).cast("int") for e in many).alias("bin")).count().collect()
    assert len(many) == 31 and len(shares) == 32 and all(abs(r["count"] / n - 1 / 32) < 0.004 for r in shares)


def test_no_rows_and_no_target_are_errors(spark):
    from weir.operators import models

    rows = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "x double, y double")
    with pytest.raises(ValueError, match="no training rows"):
        models.fit_regressor(rows.filter("x > 5"), ["x"], "y")
    with pytest.raises(Exception, match="without a target"):
        models.fit_regressor(rows, ["x"], "y")


def test_the_report_sorts_no_rows(spark):
    from weir.plans.models import _report

    rows = spark.createDataFrame([("train", 1.0, 1.5), ("train", 3.0, 2.5), ("test", 2.0, 2.0)], "split string, y double, prediction double")
    report = _report(rows, "split", "y", rows.groupBy().agg(F.lit(2.0).alias("base")), "m")
    assert "SortAggregate" not in report._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in report.select("split", "rows", "scored", "holds", "model").collect()} == {
        ("train", 2, 2, True, "m"), ("test", 1, 1, False, "m")}
