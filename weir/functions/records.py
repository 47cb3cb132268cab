"""JSON fields, nested records, message headers and column names."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F, types as T


def json_fields(df: DataFrame, col: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Add typed columns ``{alias: (path, type)}`` from JSON text; the text is parsed once."""
    parsed = df.withColumn("_json", F.try_parse_json(col))
    return parsed.withColumns(
        {a: F.try_variant_get("_json", path, typ) for a, (path, typ) in fields.items()}).drop("_json")


def header_value(headers: str, key: str) -> Column:
    """Text value of the first message header named ``key`` (NULL if there is none)."""
    hits = F.filter(headers, lambda h: h["key"] == key)
    return F.try_element_at(hits, F.lit(1))["value"].cast("string")


def has_header(headers: str, key: str, value: Column) -> Column:
    return F.exists(headers, lambda h: (h["key"] == key) & (h["value"] == value.cast("binary")))


def header_array(values: dict[str, Column]) -> Column:
    """Message headers from named columns."""
    return F.array(*[
        F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))
        for k, v in values.items()])


def snake_case(name: str) -> str:
    """Lower case with an underscore before every word; a run of capitals is one word, so
    ``jobRunID`` becomes ``job_run_id``."""
    out: list[str] = []
    for i, c in enumerate(name):
        after_small = i > 0 and (name[i - 1].islower() or name[i - 1].isdigit())
        before_small = i > 0 and name[i - 1].isupper() and name[i + 1:i + 2].islower()
        out.append("_" if c.isupper() and (after_small or before_small) else "")
        out.append(c.lower())
    return "".join(out)


def _distinct(names: list[str]) -> list[str]:
    made = [snake_case(n) for n in names]
    twice = sorted(n for n, k in Counter(made).items() if k > 1)
    if twice:
        raise ValueError(f"several columns would be named {', '.join(twice)}")
    return made


def _renamed(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([
            T.StructField(n, _renamed(f.dataType), f.nullable) for n, f in zip(_distinct(t.names), t)])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_renamed(t.elementType), t.containsNull)
    return t


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename all columns and all fields of nested records, by a cast (no data is rebuilt).  Two
    fields that would share a name are an error."""
    return df.select(*[
        F.col(f"`{f.name}`").cast(_renamed(f.dataType)).alias(n) for n, f in zip(_distinct(df.columns), df.schema)])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value in any row (one aggregate, one row collected)."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in filled.items() if n == 0])
