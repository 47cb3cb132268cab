"""Incremental file ingest: new files only, stored and evolving schemas, controlled exports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T


def stored_schema(spark: SparkSession, location: str) -> tuple[T.StructType, int] | None:
    """The newest schema kept under ``location`` and its version."""
    try:
        rows = spark.read.text(location)
        newest = rows.orderBy("version", ascending=False).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return T.StructType.fromJson(json.loads(newest.value)), newest.version


def store_schema(spark: SparkSession, location: str, schema: T.StructType, version: int) -> None:
    text = spark.createDataFrame([(schema.json(),)], "value STRING")
    text.coalesce(1).write.text(f"{location}/version={version}")


def infer_schema(spark, path: str, fmt: str, options: dict | None = None) -> T.StructType:
    return spark.read.format(fmt).options(**(options or {})).load(path).schema


def merged(old: T.DataType, new: T.DataType) -> T.DataType:
    """A type that holds both: fields of records and elements at any depth are joined, numbers
    widen, and types that have nothing in common become text."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        known = {f.name: f for f in new}
        both = [T.StructField(f.name, merged(f.dataType, known[f.name].dataType) if f.name in known else f.dataType, True) for f in old]
        return T.StructType(both + [T.StructField(f.name, f.dataType, True) for f in new if f.name not in set(old.names)])
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(merged(old.elementType, new.elementType), True)
    if isinstance(old, T.ArrayType) or isinstance(new, T.ArrayType):
        single, many = (new, old) if isinstance(old, T.ArrayType) else (old, new)
        return T.ArrayType(merged(many.elementType, single), True)      # once alone, once repeated
    if old == new or isinstance(new, T.NullType):
        return old
    if isinstance(old, T.NullType):
        return new
    for ladder in _WIDER:
        if type(old) in ladder and type(new) in ladder:
            return max(old, new, key=lambda t: ladder.index(type(t)))
    return T.StringType()


_WIDER = (
    (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType), (T.FloatType, T.DoubleType),
    (T.DateType, T.TimestampType))


def resolve_schema(
    spark, path: str, fmt: str, location: str, options: dict | None = None, evolve: bool = False,
) -> T.StructType:
    """The stored schema, inferred once; with ``evolve`` new columns are added to it."""
    kept = stored_schema(spark, location)
    if kept is None:
        schema = infer_schema(spark, path, fmt, options)
        store_schema(spark, location, schema, 1)
        return schema
    schema, version = kept
    if evolve:
        grown = merged(schema, infer_schema(spark, path, fmt, options))
        if grown != schema:
            store_schema(spark, location, grown, version + 1)
            schema = grown
    return schema


def incremental_files(
    spark: SparkSession, path: str, fmt: str, schema=None, schema_location: str | None = None,
    options: dict | None = None, evolve: bool = False,
) -> DataFrame:
    """A stream of the files below ``path`` (a folder or a glob).

    Give a schema, or a ``schema_location`` where the inferred one is kept.
    """
    if schema is None:
        if schema_location is None:
            raise ValueError("give a schema or a schema_location")
        schema = resolve_schema(spark, path, fmt, schema_location, options, evolve)
    return spark.readStream.format(fmt).schema(schema).options(**(options or {})).load(path)


def export_files(df: DataFrame, path: str, fmt: str, files: int, mode="append", **options) -> None:
    """Write with a set number of files."""
    df.repartition(files).write.mode(mode).format(fmt).options(**options).save(path)
