"""Texts as file rows, chunks, statistics, and consistency with a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions.numbers import first_number

CHUNK_TOKENS, OVERLAP_TOKENS = 500, 75


def words(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def file_table(df: DataFrame, parts: list[str], name: str, folder: str, modified: str) -> DataFrame:
    """Rows shaped as files: ``content`` and a ``metadata`` record; empty contents are dropped."""
    pieces = [p for i, c in enumerate(parts) for p in ((F.lit(" "), F.col(c)) if i else (F.col(c),))]
    full = df.withColumn("content", F.concat(*pieces)).filter(F.length(F.trim("content")) > 0)
    meta = F.struct(
        F.concat(F.lit(folder), F.col(name)).alias("file_path"),
        F.concat(F.col(name), F.lit(".txt")).alias("file_name"),
        F.length("content").cast("long").alias("file_size"),
        F.col(modified).alias("file_modification_time"))
    return full.select("content", meta.alias("metadata"))


def chunk(df: DataFrame, text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Overlapping pieces of ``size`` tokens, one row each, identified by their md5.

    Row-local and in the JVM: no shuffle carries the texts.  A piece that would only repeat
    the overlap is not made; a text without tokens has no pieces.
    """
    step = size - overlap
    toks = df.withColumn("_t", words(F.col(text))).drop(text)
    n = F.size("_t")
    pieces = F.when(n > size, 1 + F.ceil((n - size) / step)).when(n > 0, 1).otherwise(0).cast("int")
    numbers = F.when(pieces > 0, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array().cast("array<int>"))
    rows = toks.withColumn("chunk_no", F.explode(numbers))
    piece = F.array_join(F.slice("_t", F.col("chunk_no") * step + 1, F.lit(size)), " ")
    rows = rows.withColumn("chunked_text", piece).drop("_t")
    return rows.withColumn("chunk_id", F.md5("chunked_text"))


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """Words, tokens (words and single marks) and characters of each whole text."""
    return df.withColumns({
        "n_words": F.size(words(F.col(text))),
        "n_tokens": F.regexp_count(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]")),
        "n_characters": F.length(text),
    }).drop(text)


def product_text() -> Column:
    """Search document of a product from its catalog columns."""
    return F.concat(
        F.col("product_name"), F.lit(" | Category: "), F.col("category"),
        F.lit(" | Price: $"), F.col("price"), F.lit(" | Availability: "), F.col("availability"),
        F.lit(" | Warranty: "), F.col("warranty_years"), F.lit(" year(s). "), F.col("description"))


def consistency_audit(docs: DataFrame, catalog: DataFrame, key: str = "product_id") -> DataFrame:
    """Documents that contradict the catalog: claimed stock, claimed warranty."""
    doc = F.lower("indexed_doc")
    claims = docs.select(
        key,
        (doc.contains("in stock and available")).alias("claims_stock"),
        first_number(doc, r"warranty: (\d+) year").alias("claimed_years"))
    both = claims.join(catalog.select(key, "availability", "warranty_years"), key)
    return both.withColumns({
        "stock_conflict": F.col("claims_stock") & (F.lower("availability") == "discontinued"),
        "warranty_conflict": F.coalesce(F.col("claimed_years") != F.col("warranty_years"), F.lit(False)),
    }).filter("stock_conflict OR warranty_conflict").select(
        key, "stock_conflict", "warranty_conflict", F.col("claimed_years").cast("int"), "warranty_years")


def contradicting_terms(policies: DataFrame, topic: str = "topic", days: str = "days") -> DataFrame:
    """Topics for which policy rows promise different numbers of days."""
    found = policies.groupBy(topic).agg(
        F.min(days).alias("least_days"), F.max(days).alias("most_days"), F.count(F.lit(1)).alias("n_rows"))
    return found.filter("least_days <> most_days")
