import pytest
from conftest import rows

from weir.operators import cdc
from weir.operators.cdc import scd1, scd2

# out-of-order changes, a delete followed by a late older update, a re-insert after a delete, a tie
CHANGES = [
    ("a", 3, "UPDATE", 30), ("a", 1, "INSERT", 10), ("a", 2, "UPDATE", 20),
    ("b", 5, "DELETE", None), ("b", 4, "UPDATE", 44),
    ("c", 1, "INSERT", 1), ("c", 2, "DELETE", None), ("c", 3, "INSERT", 3),
    ("d", 7, "INSERT", 70), ("d", 7, "INSERT", 71),
]


@pytest.fixture
def changes(spark):
    return spark.createDataFrame(CHANGES, "k STRING, seq INT, op STRING, v INT")


def test_scd1(changes):
    assert rows(cdc.scd1(changes, ["k"], "seq", "op = 'DELETE'", ["seq", "op"])) == [("a", 30), ("c", 3), ("d", 71)]


def test_scd1_ignores_row_order(changes):
    backwards = changes.orderBy("seq", ascending=False)
    assert rows(cdc.scd1(backwards, ["k"], "seq")) == rows(cdc.scd1(changes, ["k"], "seq"))


@pytest.mark.parametrize("max_rows", [None, 1, 2])
def test_scd2(changes, max_rows):
    got = rows(cdc.scd2(changes, ["k"], "seq", "op = 'DELETE'", max_rows=max_rows), "k", "v", cdc.START, cdc.END)
    assert [g for g in got if g[0] != "d"] == [
        ("a", 10, 1, 2), ("a", 20, 2, 3), ("a", 30, 3, None), ("b", 44, 4, 5), ("c", 1, 1, 2), ("c", 3, 3, None)]
    assert [g[2:] for g in got if g[0] == "d"] == [(7, None)]


def test_as_of(changes):
    versions = cdc.scd2(changes, ["k"], "seq", "op = 'DELETE'")
    assert rows(cdc.as_of(versions, 2), "k", "v") == [("a", 20)]
    assert rows(cdc.as_of_version(changes, ["k"], "seq", 4, "op = 'DELETE'"), "k", "v") == [("a", 30), ("b", 44), ("c", 3)]


def test_upsert_checks_schema(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id INT, s STRING")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id INT, s STRING")
    assert rows(cdc.upsert(old, new, ["id"])) == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(ValueError, match="schemas differ"):
        cdc.upsert(old, new.withColumnRenamed("s", "t"), ["id"])


def test_change_set_sees_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "id INT, s STRING")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "e")], "id INT, s STRING")
    got = rows(cdc.change_set(old, new, ["id"], ["s"]))
    assert got == [(2, "update"), (3, "update"), (4, "delete"), (5, "insert")]


def test_unprocessed_without_a_target(spark):
    df = spark.createDataFrame([(1,)], "id INT")
    assert cdc.unprocessed(df, None, ["id"]) is df


def test_conditional_update_keeps_types_and_null_conditions(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id INT, v INT")
    out = cdc.conditional_update(df, "v > 10", {"v": "NULL"})
    assert out.schema == df.schema and rows(out) == [(1, 5), (2, None), (3, None)]


def test_delete_where_and_insert_if_absent(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id INT, v INT")
    assert rows(cdc.delete_where(df, "v = 5")) == [(2, None)]
    extra = spark.createDataFrame([(2, 9), (3, 9)], "id INT, v INT")
    assert rows(cdc.insert_if_absent(df, extra, ["id"])) == [(1, 5), (2, None), (3, 9)]


def test_latest_row_with_a_map_column(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2})], "k INT, seq INT, m MAP<STRING, INT>")
    assert cdc.scd1(df, ["k"], "seq").first().m == {"b": 2}
    assert cdc.scd2(df, ["k"], "seq").count() == 2


def test_ties_pick_the_same_row_as_current_and_as_open_version(spark):
    rows = [(k, 1, f"v{i}") for k in range(50) for i in range(3)]
    changes = spark.createDataFrame(rows, "k int, seq int, v string").repartition(7)
    current = {r.k: r.v for r in scd1(changes, ["k"], "seq").collect()}
    open_ = {r.k: r.v for r in scd2(changes, ["k"], "seq").collect()}
    assert current == open_ and len(current) == 50
