"""Version tables, revised totals and checked tables, batch by batch."""

import os
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F
from weir.operators import cdc
from weir.operators.latest import latest_rows
from weir.operators.quality import Rule
from weir.streaming.checked import CheckedTable
from weir.streaming.history import VersionTable
from weir.streaming.revised import RevisedTotals

CHANGES = "k long, seq long, op string, v string"


def feed(rng, n, keys=4):
    return [(rng.choice([None, *range(keys)]), rng.choice([None, *range(40)]), rng.choice(["set", "set", "del"]), rng.choice("abc"))
            for _ in range(n)]


def test_versions_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(1)
    changes = feed(rng, 90) + [(0, 5, "set", "x"), (0, 5, "set", "x"), (0, 5, "set", "y")]
    rng.shuffle(changes)
    frame = spark.createDataFrame(changes, CHANGES)
    table = VersionTable(str(tmp_path / "t"), frame.schema, ["k"], "seq", "op = 'del'")
    for batch in range(3):
        table.apply(spark.createDataFrame(changes[batch * 31:batch * 31 + 31], CHANGES), batch)
    want = rows(cdc.scd2(frame.filter("seq IS NOT NULL"), ["k"], "seq", "op = 'del'"), "k", "seq", "op", "v", cdc.START, cdc.END)
    assert rows(table.read(spark), "k", "seq", "op", "v", cdc.START, cdc.END) == want
    # a batch again, and changes delivered a second time, change nothing
    table.apply(spark.createDataFrame(changes[62:], CHANGES), 2)
    table.apply(spark.createDataFrame(changes[:31], CHANGES), 3)
    assert rows(table.read(spark), "k", "seq", "op", "v", cdc.START, cdc.END) == want
    assert spark.read.parquet(str(tmp_path / "t" / "batch_no=3")).count() == 0
    folded = table.compact(spark, str(tmp_path / "f"))
    assert rows(folded.read(spark), "k", "seq", "op", "v", cdc.START, cdc.END) == want


def test_a_late_change_writes_two_versions_only(spark, tmp_path):
    schema = spark.createDataFrame([], CHANGES).schema
    table = VersionTable(str(tmp_path / "t"), schema, ["k"], "seq")
    table.apply(spark.createDataFrame([(k, s, "set", "a") for k in range(5) for s in range(0, 100, 10)], CHANGES), 0)
    table.apply(spark.createDataFrame([(3, 55, "set", "late")], CHANGES), 1)
    written = rows(spark.read.parquet(str(tmp_path / "t" / "batch_no=1")), "k", "seq", cdc.END)
    assert written == [(3, 50, 55), (3, 55, 60)]
    assert rows(table.read(spark).filter("k = 3 AND seq BETWEEN 50 AND 60"), "seq", cdc.END) == [(50, 55), (55, 60), (60, 70)]


ROWS = "id long, seq long, gone boolean, grp string, value long"


def totals(changes):
    last = {}
    for id_, seq, gone, grp, value in changes:
        if id_ not in last or seq > last[id_][0]:
            last[id_] = (seq, gone, grp, value)
    groups = defaultdict(list)
    for _, gone, grp, value in last.values():
        if not gone:
            groups[grp].append(value)
    out = []
    for grp, held in groups.items():
        known = [v for v in held if v is not None]
        out.append((grp, len(held), sum(known) if known else None, min(known, default=None), max(known, default=None), len(set(known))))
    return sorted(out, key=repr)


def test_totals_through_inserts_updates_and_deletes(spark, tmp_path):
    rng = random.Random(7)
    changes = [(rng.randint(0, 30), s, rng.random() < .25, rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 3, 9]))
               for s in range(200)]
    rng.shuffle(changes)
    schema = spark.createDataFrame([], ROWS).schema
    table = RevisedTotals(str(tmp_path / "t"), schema, ["id"], ["grp"])
    for batch, at in enumerate(range(0, 200, 50)):
        part = spark.createDataFrame(changes[at:at + 50], ROWS)
        table.apply(part, batch)
        if batch % 2:
            table.apply(part, batch)               # a repeated batch
        assert rows(table.read(spark), "grp", "rows", "total", "least", "greatest", "different") == totals(changes[:at + 50])


def test_only_touched_groups_are_written(spark, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    table = RevisedTotals(str(tmp_path / "t"), schema, ["id"], ["grp"])
    table.apply(spark.createDataFrame([(i, 0, False, "abc"[i % 3], i) for i in range(9)], ROWS), 0)
    table.apply(spark.createDataFrame([(0, 1, True, "a", 0), (1, 1, False, "b", 1)], ROWS), 1)
    # the row of b says what it said before
    assert rows(spark.read.parquet(str(tmp_path / "t" / "results" / "batch_no=1")), "grp", "least", "rows") == [("a", 3, 2)]


RULES = [Rule("positive", "v > 0", "drop"), Rule("small", "v < 100", "drop"), Rule("even", "v % 2 = 0"), Rule("known", "id IS NOT NULL", "fail")]


def test_kept_quarantined_and_counted_rows_add_up(spark, tmp_path):
    table = CheckedTable(str(tmp_path / "t"), RULES)
    first = spark.createDataFrame([(1, 5), (2, -1), (3, 200), (4, None), (5, 6)], "id long, v long")
    second = spark.createDataFrame([(6, 8), (7, 0)], "id long, v long")
    for batch, part in ((0, first), (1, second), (1, second)):     # the last one is repeated
        table.apply(part, batch)
    assert rows(table.kept(spark), "id") == [(1,), (5,), (6,)]
    assert rows(table.quarantined(spark), "id", "failed_rules") == [
        (2, ["positive", "even"]), (3, ["small"]), (4, ["positive", "small", "even"]), (7, ["positive"])]
    assert rows(table.metrics(spark), "rule", "passed", "failed") == [
        ("even", 4, 3), ("known", 7, 0), ("positive", 4, 3), ("small", 5, 2)]
    with pytest.raises(Exception, match="known"):
        table.apply(spark.createDataFrame([(9, 1), (None, 1)], "id long, v long"), 2)
    # a batch that was not finished is not seen
    second.withColumns({"failed_rules": F.array().cast("array<string>"), "kept": F.lit(True)}).write.partitionBy("kept").parquet(
        str(tmp_path / "t" / "rows" / "batch_no=3"))
    assert table.kept(spark).count() + table.quarantined(spark).count() == 7
    assert CheckedTable(str(tmp_path / "none"), RULES).metrics(spark).count() == 0


def test_latest_rows(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, -5, 0, 7]), rng.choice("ab"), rng.random()) for _ in range(60)] * 2
    frame = spark.createDataFrame(data, "k long, o long, s string, x double")
    for df in (frame, frame.withColumn("o", F.timestamp_micros("o"))):
        got = latest_rows(df, ["k"], ["o"]).collect()
        assert len(got) == 4
        for r in got:
            orders = [q.o for q in df.filter(F.col("k").eqNullSafe(r.k)).select("o").distinct().collect() if q.o is not None]
            assert r.o == max(orders)
        assert "SortAggregate" not in latest_rows(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    only_null = latest_rows(frame.filter("o IS NULL"), ["k"], ["o"])
    assert only_null.count() == frame.filter("o IS NULL").select("k").distinct().count()
    by_text = latest_rows(frame, ["k"], ["s"])             # the way over whole rows
    assert by_text.count() == 4 and {r.s for r in by_text.collect()} == {"b"}
    assert latest_rows(frame.limit(0), ["k"], ["o"]).count() == 0


def test_rows_of_one_place_are_decided_the_same_way_in_any_order(spark):
    data = [(1, 5, v) for v in "abcdefgh"]
    pick = lambda part: latest_rows(spark.createDataFrame(part, "k long, o long, v string"), ["k"], ["o"]).first().v
    assert len({pick(random.Random(i).sample(data, 8)) for i in range(3)}) == 1


def test_files_of_the_version_table_are_found_again(spark, tmp_path):
    schema = spark.createDataFrame([], CHANGES).schema
    table = VersionTable(str(tmp_path / "t"), schema, ["k"], "seq")
    assert table.read(spark).count() == 0
    table.apply(spark.createDataFrame([], CHANGES), 0)
    assert table.read(spark).count() == 0 and os.path.isdir(tmp_path / "t" / "batch_no=0")
