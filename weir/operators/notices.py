"""``KEY: value`` message text as rows and as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions.fixed_values import NOTICE_KEYS


def _key(line: Column) -> Column:
    return F.trim(F.split_part(line, F.lit(":"), F.lit(1)))


def _value(line: Column) -> Column:
    """Everything behind the first colon, so values may hold colons themselves."""
    return F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line)))


def key_values(df: DataFrame, text: str) -> DataFrame:
    """One row per line that is not blank: line number, key, value."""
    lines = df.select("*", F.posexplode(F.split(text, "\n")).alias("line_no", "_line")).drop(text)
    lines = lines.filter(F.trim("_line") != "")
    return lines.withColumns({"key": _key(F.col("_line")), "value": _value(F.col("_line"))}).drop("_line")


def _pairs(text: str) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda l: F.trim(l) != "")
    return F.transform(lines, lambda l: F.struct(_key(l).alias("key"), _value(l).alias("value")))


def _values_of(key: str) -> Column:
    return F.transform(F.filter("_pairs", lambda p: p["key"] == key), lambda p: p["value"])


def pivot_notices(df: DataFrame, text: str, by: list[str], keys=NOTICE_KEYS) -> DataFrame:
    """One row per ``by`` and one column per key: the largest value where a key repeats.

    The columns are picked inside each message first, so the shuffle moves one row per
    message and not one per line.
    """
    per_message = df.select(*by, _pairs(text).alias("_pairs")).select(
        *by, *[F.array_max(_values_of(k)).alias(k) for k in keys])
    return per_message.groupBy(*by).agg(*[F.max(k).alias(k) for k in keys])


def typed_notices(pivoted: DataFrame) -> DataFrame:
    return pivoted.withColumns({
        "NOTICE_DATE": F.col("NOTICE_DATE").try_cast("timestamp"),
        "MERIT": F.col("MERIT").try_cast("decimal(10,0)"),
    })


def joined_comments(df: DataFrame, text: str) -> DataFrame:
    """All COMMENTS lines of a message in one value, and all its values in one text."""
    others = F.transform(F.filter("_pairs", lambda p: p["key"] != "COMMENTS"), lambda p: p["value"])
    out = df.withColumn("_pairs", _pairs(text)).withColumn(
        "comments", F.array_join(_values_of("COMMENTS"), " "))
    return out.withColumn(
        "all_text", F.array_join(F.concat(others, F.array("comments")), ", ")).drop("_pairs", text)
