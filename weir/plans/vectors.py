"""Nearest neighbours: each label's mean vector asks for the vectors most like it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators.vectors import centroids, cosine_topk, retrieval_context
from weir.registry import query
from weir.tables import load

K = 8
_TOP = f"""
  WITH e AS (SELECT label, vec_id, embedding, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  q AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT q.label AS query_id, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.c) AS score FROM embeddings v, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
  SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}"""


def neighbours(spark, d) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    asked = centroids(vectors, "label", "embedding")
    return cosine_topk(vectors.select(F.col("vec_id").alias("id"), "embedding"), asked, K)


@query("vector_topk", _TOP)
def vector_topk(spark, d) -> DataFrame:
    return neighbours(spark, d).withColumn("score", F.round("score", 6))


@query("retrieval_context", f"""
  SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM ({_TOP}) t JOIN documents ON id = doc_id GROUP BY 1""")
def contexts(spark, d) -> DataFrame:
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval_context(neighbours(spark, d), texts)
