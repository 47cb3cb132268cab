"""Cutting hot keys into segments must not change any result."""

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from weir.operators.ordered import SEG, next_in_order, number_rows, segment
from weir.operators.sampling import even_subsample, stride_sample, systematic_sample
from weir.streaming.monitor import monitor_batch


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows, NULL is hot too, and one time is shared by very many rows."""
    n = 6_000
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 50 + 1)
    at = F.when(F.col("id") % 4 == 0, 777).otherwise(F.xxhash64("id") % 1000)
    return spark.range(n).select(
        "id", key.cast("int").alias("k"), at.cast("long").alias("t"),
        (F.abs(F.xxhash64("id", F.lit(7))) % 400 / 8).alias("temperature"),
        F.lit(10.0).alias("humidity"), F.lit(1.0).alias("co2_level"), F.lit(1.0).alias("pm25_level"))


def test_segments_are_bounded_and_ordered(skewed):
    s = segment(skewed, ["k"], ["t", "id"], 100)
    assert s.split
    sizes = s.df.groupBy("k", SEG).agg(F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi"))
    found = sorted(sizes.collect(), key=lambda r: (str(r.k), r[SEG]))
    assert max(r.n for r in found) <= 250
    for a, b in zip(found, found[1:]):
        if a.k == b.k:
            assert tuple(a.hi) < tuple(b.lo)


def test_nothing_is_cut_without_a_hot_key(skewed):
    s = segment(skewed, ["k"], ["t", "id"], 1_000_000)
    assert not s.split


@pytest.mark.parametrize("max_rows", [60, 500])
def test_number_rows(skewed, max_rows):
    w = Window.partitionBy("k")
    want = skewed.withColumn("rn", F.row_number().over(w.orderBy("t", "id"))).withColumn("c", F.count("*").over(w))
    got = number_rows(skewed, ["k"], ["t", "id"], "rn", "c", max_rows=max_rows)
    assert rows(got, "id", "rn", "c") == rows(want, "id", "rn", "c")


@pytest.mark.parametrize("max_rows", [60, 500])
def test_next_in_order(skewed, max_rows):
    want = skewed.withColumn("nx", F.lead("t").over(Window.partitionBy("k").orderBy("t", "id")))
    got = next_in_order(skewed, ["k"], ["t", "id"], "nx", max_rows=max_rows)
    assert rows(got, "id", "nx") == rows(want, "id", "nx")


@pytest.mark.parametrize("max_rows", [60, None])
def test_monitor(skewed, max_rows):
    """Against the definition: a hot reading joins the state before the state is read."""
    state, want = {}, []
    for r in sorted(skewed.collect(), key=lambda r: (r.t, r.id)):
        hot = state.setdefault(r.k, [])
        if r.temperature > 25:
            hot.append(r.temperature)
        every = hot + [r.temperature]
        last = hot[-1] if hot else r.temperature
        trend = "rising" if r.temperature > last else "falling" if r.temperature < last else "stable"
        want.append((r.id, round(sum(every) / len(every), 6), trend, len(hot)))
    got = monitor_batch(skewed, "k", "t", "id", max_rows=max_rows)
    got = [(r[0], round(r[1], 6), r[2], r[3]) for r in rows(
        got, "id", "hourly_avg_temp", "temperature_trend", "high_temp_count")]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("max_rows", [60, None])
@pytest.mark.parametrize("n", [1, 7, 150, 5000])
def test_even_subsample_is_first_of_ntile(skewed, n, max_rows):
    b = F.ntile(n).over(Window.partitionBy("k").orderBy("t", "id"))
    first = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("t", "id"))
    want = skewed.withColumn("bucket", b).withColumn("f", first).filter("f = 1")
    got = even_subsample(skewed, ["k"], ["t", "id"], n, max_rows=max_rows)
    assert rows(got, "id", "bucket") == rows(want, "id", "bucket")


def test_systematic_and_stride_sample(skewed):
    one = systematic_sample(skewed, F.col("id") % 5, ["id"], 10, max_rows=90)
    assert sorted(r.id for r in one.collect()) == [i for i in range(6000) if (i // 5 + 1) % 10 == 0]
    few = stride_sample(skewed.filter("k = 0"), ["k"], ["id"], 100, max_rows=90)
    assert few.count() == 100


def test_rows_without_a_sort_value_are_cut_too(spark):
    """Half of a key's times are missing, or all of them."""
    df = spark.range(1_000).select("id", F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 9).alias("t"))
    for frame in (df, df.withColumn("t", F.lit(None).cast("long"))):
        s = segment(frame, ["k"], ["t", "id"], 100)
        assert s.split and max(r["count"] for r in s.df.groupBy("k", SEG).count().collect()) <= 250
        want = frame.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
        assert rows(number_rows(frame, ["k"], ["t", "id"], "rn", max_rows=100), "id", "rn") == rows(want, "id", "rn")
