"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, folder of the tables) and works on all that the stage before kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.llm import packing, simhash, suffixes, toxicity
from weir.llm.common import pinned, read
from weir.llm.queries import REPEAT_BYTES, SEQUENCE, SIMHASH_BITS, SIMHASH_SHINGLE, WORD_VOCABULARY
from weir.registry import query
from weir.session import configure

#: No SQL has the tokenizer, the hash or the fitted model; the stages are tested against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model does not reject.  The model is fitted on labelled documents
    of the raw table, so that it does not depend on what an earlier run kept.

    NULL and empty texts hold nothing toxic and stay, like rows that are alike; rows without an id are
    decided by their text like others.  Without toxic labels all stay.  Columns may have any names besides
    those of the table; an empty table gives no rows."""
    spark = configure(spark)
    model = toxicity.train(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return toxicity.without_toxic(docs, model)


def first_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Texts without words, NULL among them, are near-duplicates of each other.  Rows of one id are one
    document and stay together; rows without an id cannot be told apart and stay."""
    configure(spark)
    return simhash.first_of_each(docs, SIMHASH_SHINGLE, SIMHASH_BITS)


def without_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that start earlier in the corpus; ``n_chars`` follows the text.

    NULL texts stay NULL, texts of under 100 bytes stay as they are, a text all of which is repeated becomes
    empty.  Rows of one id are one document.  Columns may have any names."""
    configure(spark)
    left = suffixes.without_repeats(docs, REPEAT_BYTES)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of tokens, with their token ids.

    NULL and empty texts are one piece, the end id; rows alike are packed each, a NULL id is kept.  Columns
    besides id and text are left out."""
    configure(spark)
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY), SEQUENCE, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean), ("near_duplicates", first_copies), ("repeated_passages", without_passages), ("packing", packed)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages over the documents of ``folder``, each written to the shared folder and read again."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES:
        docs = pinned(stage(spark, docs, folder), name)
    return docs


query("pipeline", ORACLE_SQL)(run)
