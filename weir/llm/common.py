"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weir.session import pinned, shared_dir  # noqa: F401  (re-exported for the operators)

ROWS_PER_STEP = 256            # texts one Python step holds at a time


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """For a join with a table that grows with the corpus: never gathered on the driver to be broadcast,
    however small its file is (hash tables of numbers take ten times the room of their Parquet file)."""
    return df.hint("merge")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def per_text(df: DataFrame, ids: list[str], text: str, schema: str,
             make: Callable[[], Callable[[str], tuple | list]]) -> DataFrame:
    """Row-local work on texts: one output row per input row.

    ``make()`` runs once per task and returns the function of a text; NULL texts are empty.
    ``ids`` columns come first in the output, ``schema`` describes what the function returns.
    """
    chosen = df.select(*[F.col(c) for c in ids], text_or_empty(text))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(at, ROWS_PER_STEP)
                rows = [work(t) for t in part.column(part.num_columns - 1).to_pylist()]
                columns = list(zip(*rows)) if rows else []
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                for k, values in enumerate(columns):
                    arrays.append(pa.array(values, type=types[k]))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = f"{', '.join(kinds)}, {schema}" if kinds else schema
    described = to_arrow_schema(StructType.fromDDL(out))
    names, types = described.names, [f.type for f in described][len(ids):]
    return chosen.mapInArrow(run, out)
