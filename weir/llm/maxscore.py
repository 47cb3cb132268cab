"""Exact top-k inner products by MaxScore over sharded postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weir.llm.common import pinned

ROWS = 32_768                  # vectors of a shard
QUERIES = 32_768               # query vectors that meet a shard in one task
_LEAST_ROWS = 4_096            # a shard is not cut smaller to use more cores


class Postings:
    """One shard: per term, a component and a sign, the rows that hold it, largest weights first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order].T)
        weights = np.concatenate([np.maximum(self.vectors, 0), np.maximum(-self.vectors, 0)])
        self.most = weights.max(axis=1, initial=0)
        self.sorted = np.argsort(-weights, axis=1, kind="stable").astype(np.int32)
        self.held = (weights > 0).sum(axis=1)

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of the shard, ties to the smaller id; ``own`` is left out."""
        dims = len(query)
        terms = np.flatnonzero(query)
        postings = np.where(query[terms] > 0, terms, terms + dims)
        factor = np.abs(query[terms])
        bound = factor * self.most[postings]
        order = np.argsort(bound, kind="stable")          # least bounds first
        terms, postings, factor, bound = terms[order], postings[order], factor[order], bound[order]
        below = np.concatenate([[0], np.cumsum(bound)])
        threshold = self._seed(query, postings[::-1][:2], own, k)
        # non-essential: the longest run of least terms that cannot reach the threshold together
        split = int(np.searchsorted(below, threshold, side="left")) - 1
        split = min(max(split, 0), len(terms))
        met = np.zeros(len(self.ids), dtype=bool)
        if threshold <= 0:
            met[:] = True                                  # rows that hold no term of the query count too
        for p in postings[split:][::-1] if threshold > 0 else ():
            met[self.sorted[p, :self.held[p]]] = True
        rows = np.flatnonzero(met & (self.ids != own))
        if not len(rows):
            return []
        # essential terms first, then the others, largest bounds first, while a row stays competitive
        score = np.zeros(len(rows), dtype=np.float64)
        at = len(terms)
        whole = len(rows) == met.size
        for upto in self._steps(split, len(terms)):
            chosen = terms[upto:at]
            part = self.vectors[chosen] if whole else self.vectors[np.ix_(chosen, rows)]
            score += query[chosen] @ part
            at = upto
            alive = score + below[upto] >= threshold
            if not alive.all():
                rows, score, whole = rows[alive], score[alive], False
        if len(rows) > k:
            least = -np.partition(-score, k - 1)[k - 1]
            alive = score >= least
            rows, score = rows[alive], score[alive]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return [(int(score[i]), int(self.ids[rows[i]])) for i in best]

    def _seed(self, query: np.ndarray, postings: np.ndarray, own: int, k: int) -> float:
        """A score that k rows reach: that of the k-th of the rows with the largest weights."""
        tops = [self.sorted[p, :min(self.held[p], 8 * k)] for p in postings]
        rows = np.unique(np.concatenate(tops)) if tops else np.zeros(0, dtype=np.int64)
        rows = rows[self.ids[rows] != own]
        if len(rows) < k:
            return -np.inf
        scores = query @ self.vectors[:, rows]
        return float(-np.partition(-scores, k - 1)[k - 1])

    @staticmethod
    def _steps(split: int, terms: int) -> list[int]:
        """Ends of the runs of terms that are added at a time, down to 0."""
        first = min(split, terms)
        return sorted({first, first // 2, first // 4, 0}, reverse=True)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)``: each component x as floor(scale * x); without vectors that are NULL or hold NULL,
    NaN or infinite components, and without NULL ids.  A vector whose square could pass 2**53 stops the job
    with an error that names it: below that every product of two vectors, and every part of it, is exact."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    square = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1))
    whole = F.transform(vector, lambda x: F.floor(x * scale).cast("long"))
    stop = F.raise_error(F.concat(F.lit("the vector with the id "), F.col(id_col).cast("string"), F.lit(" is too long for exact products")))
    return df.filter(F.col(id_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.when(square < float(1 << 53), whole).otherwise(stop.cast("array<bigint>")).alias("v"))


def _padded(vectors: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.float64)
    for row, v in enumerate(vectors):
        out[row, :len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, rows: int = ROWS, per_task: int = QUERIES) -> DataFrame:
    """The ``k`` rows of ``vectors(id, v)`` with the largest inner product for each of ``queries(id, v)``,
    integer vectors whose products stay below 2**53: ``query_id, rank, vec_id, score``; ties go to the
    smaller id.

    Vectors are dealt over shards and queries over blocks of bounded size; a task takes one of each,
    builds the shard's postings and searches them for every query of the block.  Missing components
    count as 0.  A query's own id is no candidate; rows that repeat an id are candidates each, but one
    query.  Per task and query at most ``k`` rows go on to be merged.
    """
    n, asked = vectors.count(), queries.select("id").distinct().count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // rows), min(cores, n // _LEAST_ROWS))
    blocks = max(1, -(-asked // per_task))
    dealt = lambda name, parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(name)
    every = lambda name, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    corpus = vectors.select("id", "v", dealt("shard", shards), every("block", blocks))
    wanted = queries.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", dealt("block", blocks), every("shard", shards))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            lists, asking = left.column("v").to_pylist(), right.column("v").to_pylist()
            dims = max(map(len, lists + asking))
            postings = Postings(left.column("id").to_numpy(), _padded(lists, dims))
            for own, query in zip(right.column("id").to_pylist(), _padded(asking, dims)):
                found += [(own, vec, score) for score, vec in postings.search(query, own, k)]
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns)})

    partial = corpus.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(
        cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(df: DataFrame, every: int, k: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``top_k`` over a table's own rows, components x taken as floor(scale * x): rows whose id is
    divisible by ``every`` ask.  Vectors that are NULL or hold NULL or non-finite components and rows
    without an id take no part; other columns are left out; an empty table gives no rows."""
    vectors = pinned(quantised(df, id_col, vector_col, scale), "vectors")
    return top_k(vectors, vectors.filter(F.col("id") % every == 0), k)
