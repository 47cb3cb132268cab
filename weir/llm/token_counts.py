"""Exact token counts of every prefix of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.llm import words
from weir.llm.common import per_text


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 prefixes: bool = False) -> DataFrame:
    """Per document: ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars``, the length in code
    points of its longest prefix of at most ``limit`` tokens; with ``prefixes`` also ``prefix_tokens``,
    the token count of every prefix (entry p: the first p code points).

    Dynamic programming over prefixes: a prefix's count follows from the count before its last piece
    and, inside a piece, from the last token of each shorter prefix (``words.WordBpe``).  The total is
    the last entry, and a budget question reads the entries; nothing is encoded again.

    NULL and empty texts have 0 tokens.  Repeated rows are counted each.  Other columns of ``docs``
    are left out, so their names cannot clash.  Row-local: no shuffle.
    """

    def make():
        bpe = words.load(vocabulary)

        def count(text: str):
            n = bpe.count(text)
            fits = len(text) if n <= limit else bpe.fitting(text, limit)
            row = (len(text.encode("utf-8")), n, n > limit, fits)
            return (*row, bpe.prefix_counts(text).tolist()) if prefixes else row

        return count

    schema = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return per_text(docs, [id_col], text_col, schema + (", prefix_tokens array<long>" if prefixes else ""), make)


def truncated(counted: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` cut to what fits the limit of ``token_counts``; ids must be unique."""
    cut = counted.select(F.col(id_col).alias("_cut_id"), F.col("fit_chars").cast("int").alias("_cut_chars"))
    rows = docs.join(cut, F.col(id_col) == F.col("_cut_id"))
    return rows.withColumn(text_col, F.substring(F.col(text_col), F.lit(1), F.col("_cut_chars"))).drop("_cut_id", "_cut_chars")
