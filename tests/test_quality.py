import pytest
from conftest import rows

from weir.operators import quality
from weir.operators.quality import ExpectationFailed, Rule

RULES = [Rule("big", "v > 10", "drop"), Rule("even", "v % 2 = 0", "drop"), Rule("small", "v < 100")]


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, 12), (2, 7), (3, None), (4, 200), (5, 13)], "id INT, v INT")


def test_null_predicate_is_a_violation(df):
    assert rows(quality.clean(df, RULES), "id") == [(1,), (4,)]


def test_quarantine_is_the_complement_and_names_all_rules(df):
    bad = {r.id: r.failed_rules for r in quality.quarantine(df, RULES).collect()}
    assert bad == {2: ["big", "even"], 3: ["big", "even", "small"], 5: ["even"]}


def test_metrics(df):
    got = {r.rule: (r.action, r.passed, r.failed) for r in quality.metrics(df, RULES).collect()}
    assert got == {"big": ("drop", 3, 2), "even": ("drop", 2, 3), "small": ("log", 3, 2)}


def test_fail_rule_names_itself(df):
    with pytest.raises(Exception, match="expectation violated: set"):
        quality.clean(df, [Rule("set", "v IS NOT NULL", "fail")]).collect()


def test_fail_rule_passes_clean_rows(df):
    assert quality.clean(df, [Rule("id set", "id IS NOT NULL", "fail"), RULES[0]]).count() == 3


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_failed_write_leaves_the_table_unchanged(spark, df, tmp_path, mode):
    path = str(tmp_path / "t")
    df.limit(2).write.parquet(path)
    before = rows(spark.read.parquet(path))
    with pytest.raises(ExpectationFailed if mode == "overwrite" else Exception):
        quality.write_checked(df, path, [Rule("set", "v IS NOT NULL", "fail")], mode)
    assert rows(spark.read.parquet(path)) == before


def test_observed_counts_come_with_the_write(spark, df, tmp_path):
    kept, seen = quality.observed(df, RULES, "counts")
    kept.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"rows": 5, "failed: big": 2, "failed: even": 3, "failed: small": 2}


def test_unknown_action():
    with pytest.raises(ValueError):
        Rule("x", "true", "warn")
