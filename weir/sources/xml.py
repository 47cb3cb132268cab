"""XML rows: row tags, XSD checks, corrupt and unmatched data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weir.session import pinned

CORRUPT = "_corrupt_record"


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema=None, xsd: str | None = None) -> DataFrame:
    """One row per ``row_tag`` element; attributes are ``_name``, repeated children arrays.

    With an XSD give a schema that includes ``_corrupt_record``: rows that do not validate
    keep their text there.
    """
    reader = spark.read.format("xml").option("rowTag", row_tag)
    if schema is not None:
        reader = reader.schema(schema)
    if xsd is not None:
        reader = reader.option("rowValidationXSDPath", xsd)
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
    return reader.load(path)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that validated, and the texts of those that did not.

    The parsed rows are stored once: validation is not repeated for the second part, and the
    reader refuses plans that need the corrupt text alone.
    """
    parsed = pinned(df, "xml")
    bad = F.col(CORRUPT).isNotNull()
    return parsed.filter(~bad).drop(CORRUPT), parsed.filter(bad).select(CORRUPT)


def rescue_unmatched(df: DataFrame, expected: T.StructType, column: str = "_rescued_data") -> DataFrame:
    """Keep the expected columns; pack everything else a row holds into one JSON column."""
    extra = [c for c in df.columns if c not in expected.names]
    kept = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in expected]
    if not extra:
        return df.select(*kept, F.lit(None).cast("string").alias(column))
    any_extra = F.coalesce(*[F.col(c).cast("string") for c in extra]).isNotNull()
    return df.select(*kept, F.when(any_extra, F.to_json(F.struct(*extra))).alias(column))


def xml_view(spark: SparkSession, name: str, path: str, row_tag: str) -> DataFrame:
    """A SQL view straight over XML files."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW {name} USING xml
                  OPTIONS (path '{path}', rowTag '{row_tag}')""")
    return spark.table(name)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def parsed_like_first(df: DataFrame, column: str) -> DataFrame:
    """``column`` of XML texts as a struct.  The schema is that of one of the texts, the least one; texts
    without one of its elements give NULL there.  One text comes to the driver; without any nothing is parsed."""
    sample = df.agg(F.min(column)).first()[0]
    if sample is None:
        return df
    schema = df.sparkSession.range(1).select(F.schema_of_xml(F.lit(sample))).first()[0]
    return df.withColumn(column, F.from_xml(column, schema))
