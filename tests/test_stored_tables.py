"""Tables with a timeline, and partitioned tables that are rewritten in part."""

import os

import pytest
from conftest import rows
from weir.operators.partitioned import PartitionedTable
from weir.operators.timeline import Timeline

SCHEMA = "k long, v string"


def committed(spark, path, every):
    table = Timeline(path, spark.createDataFrame([], SCHEMA).schema, ["k"], every=every)
    steps = [[(1, "a"), (2, "a")], [(2, "b"), (3, "b")], [(1, None)], [(4, "d")], [(2, "e")]]
    for day, step in enumerate(steps, 1):
        table.commit(spark.createDataFrame(step, SCHEMA), f"2024-01-0{day} 12:00:00", "v IS NULL")
    return table


@pytest.mark.parametrize("every", [1, 2, 100])
def test_reads_as_of_versions_and_times(spark, tmp_path, every):
    table = committed(spark, str(tmp_path / "t"), every)
    want = {0: [], 1: [(1, "a"), (2, "a")], 2: [(1, "a"), (2, "b"), (3, "b")], 3: [(2, "b"), (3, "b")],
            4: [(2, "b"), (3, "b"), (4, "d")], 5: [(2, "e"), (3, "b"), (4, "d")]}
    for version, expected in want.items():
        assert rows(table.read(spark, version=version)) == expected
    assert rows(table.read(spark, timestamp="2024-01-02 11:59:59")) == want[1]
    assert rows(table.read(spark, timestamp="2024-01-02 12:00:00")) == want[2]
    assert rows(table.read(spark, timestamp="2023-01-01")) == [] and rows(table.read(spark)) == want[5]
    with pytest.raises(ValueError):
        table.read(spark, version=6)


def test_a_read_touches_the_snapshot_and_later_changes_only(spark, tmp_path):
    table = committed(spark, str(tmp_path / "t"), 2)
    parts = {os.path.relpath(f, f"file://{tmp_path}/t").split("/part")[0] for f in table.read(spark, version=5).inputFiles()}
    assert {p.split("t/")[-1] for p in parts} >= {"changes/version=5", "snapshots/version=4"}
    read = table.read(spark, version=5)._jdf.queryExecution().executedPlan().toString()
    assert "(version#" in read and "PartitionFilters: [isnotnull(version" in read


def test_a_commit_that_failed_is_written_over(spark, tmp_path):
    table = committed(spark, str(tmp_path / "t"), 2)
    left = spark.createDataFrame([(9, "left over", False)], SCHEMA + ", gone boolean")
    left.write.parquet(str(tmp_path / "t" / "changes" / "version=6"))
    left.write.parquet(str(tmp_path / "t" / "snapshots" / "version=6"))
    assert rows(table.read(spark)) == [(2, "e"), (3, "b"), (4, "d")]
    assert table.commit(spark.createDataFrame([(5, "f")], SCHEMA), "2024-02-01", "v IS NULL") == 6
    assert rows(table.read(spark)) == [(2, "e"), (3, "b"), (4, "d"), (5, "f")]


def files(path):
    return {p.name: sorted(f.name for f in p.iterdir() if f.name.startswith("part")) for p in path.iterdir() if p.is_dir()}


def test_only_touched_partitions_are_written_again(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"v{i}", None if i % 5 == 4 else i % 5) for i in range(20)], "k long, v string, p long")
    table = PartitionedTable(spark, str(tmp_path / "t"), frame.schema, "p")
    table.create(frame)
    start = files(tmp_path / "t")
    changed = lambda: {name for name, held in files(tmp_path / "t").items() if start.get(name) != held}
    table.upsert(spark.createDataFrame([(1, "new", 1), (100, "added", 7)], frame.schema), ["k"])
    assert changed() == {"p=1", "p=7"}
    table.update("k = 4", {"v": "'null part'"})
    assert changed() == {"p=1", "p=7", "p=__HIVE_DEFAULT_PARTITION__"}
    table.delete("p = 2 OR k = 3")
    assert "p=2" not in files(tmp_path / "t") and changed() == {"p=1", "p=3", "p=7", "p=__HIVE_DEFAULT_PARTITION__"}
    table.delete("k = 12345")
    table.upsert(frame.limit(0), ["k"])
    want = [(i, "new" if i == 1 else "null part" if i == 4 else f"v{i}", None if i % 5 == 4 else i % 5)
            for i in range(20) if i % 5 != 2 and i != 3] + [(100, "added", 7)]
    assert rows(table.read()) == sorted(want, key=repr)
    table.delete("p IS NULL")
    assert "p=__HIVE_DEFAULT_PARTITION__" not in files(tmp_path / "t")
    with pytest.raises(ValueError):
        table.update("k = 1", {"p": "3"})


def test_a_change_run_again_gives_the_same(spark, tmp_path):
    frame = spark.createDataFrame([(i, "v", i % 3) for i in range(9)], "k long, v string, p long")
    table = PartitionedTable(spark, str(tmp_path / "t"), frame.schema, "p")
    table.create(frame)
    for _ in range(2):
        table.upsert(spark.createDataFrame([(0, "x", 0), (50, "y", 0)], frame.schema), ["k"])
        table.delete("k = 4")
    assert len(rows(table.read())) == 9 and rows(table.read().filter("p = 0")) == [(0, "x", 0), (3, "v", 0), (50, "y", 0), (6, "v", 0)]
