"""Exact nearest neighbours by cosine similarity, with cells round pivots that queries can skip."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from weir.session import pinned

MAX_PIVOTS = 1_024
ROWS_PER_BLOCK = 10_000        # rows of a cell that one task holds
QUERIES_PER_BLOCK = 1_000      # queries that it compares them with
MERGES = 64                    # parts in which the results for one query are merged first

_OUT = "query_id LONG, id LONG, score DOUBLE"


def centroids(df: DataFrame, label: str, embedding: str) -> DataFrame:
    """Mean vector per label (combined before the shuffle)."""
    mean = df.groupBy(label).agg(Summarizer.mean(array_to_vector(embedding)).alias("_m"))
    return mean.select(F.col(label).cast("long").alias("query_id"), vector_to_array("_m").alias("embedding"))


def _matrix(column, spare: int = 0) -> np.ndarray:
    """Unit-length rows.  A zero vector scores 0 with everything: it points along one of two more
    dimensions, ``spare`` 0 or 1, which nothing it is compared with has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    m = flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    out = np.zeros((len(m), m.shape[1] + 2))
    np.divide(m, norm, out=out[:, :-2], where=norm > 0)
    out[norm[:, 0] == 0, m.shape[1] + spare] = 1.0
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _best(qids, qmat, ids, mat, k):
    """The k best of these rows for every query, ties by smaller id.  Scores are rounded far below any use,
    so that equal vectors tie whatever block they are in."""
    scores = np.round(qmat @ mat.T, 12)
    keep = min(k, scores.shape[1])
    q_out, id_out, s_out = [], [], []
    for q, row in zip(qids, scores):
        if keep < len(row):
            edge = np.partition(row, -keep)[-keep]
            cand = np.flatnonzero(row >= edge)
        else:
            cand = np.arange(len(row))
        cand = cand[np.lexsort((ids[cand], -row[cand]))][:keep]
        q_out.append(np.full(len(cand), q))
        id_out.append(ids[cand])
        s_out.append(row[cand])
    cat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.array([], dtype=t)
    return pa.RecordBatch.from_arrays(
        [pa.array(cat(q_out, "int64")), pa.array(cat(id_out, "int64")), pa.array(cat(s_out, "float64"))],
        names=["query_id", "id", "score"])


@dataclass(frozen=True)
class Cells:
    """A corpus dealt to the nearest of some of its own vectors: the pivots, the stored rows with their
    ``cell`` and ``block``, and per cell its rows, radius and blocks."""

    pivots: np.ndarray
    rows: DataFrame
    sizes: np.ndarray
    radii: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // ROWS_PER_BLOCK))


def in_cells(corpus: DataFrame, pivots: int | None = None) -> Cells:
    """Deal ``corpus(id, embedding)`` to cells.  Pivots are the vectors with the least hash of their id, as
    many as the square root of the rows, ``MAX_PIVOTS`` at most: a bounded list, like the cells' sizes
    and radii the only thing that comes to the driver."""
    usable = corpus.select(F.col("id").cast("long").alias("id"), "embedding").filter("embedding IS NOT NULL")
    n = pivots or max(1, min(MAX_PIVOTS, math.isqrt(usable.count())))
    chosen = _matrix(usable.orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").toArrow().column("embedding"))

    def deal(batches):
        for b in batches:
            if b.num_rows:
                far = _apart(_matrix(b.column("embedding")), chosen)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("embedding"), pa.array(cell, "int32"), pa.array(far[np.arange(len(cell)), cell])],
                    names=["id", "embedding", "cell", "far"])

    kind = usable.schema["embedding"].dataType.simpleString()
    rows = pinned(usable.mapInArrow(deal, f"id LONG, embedding {kind}, cell INT, far DOUBLE"), "cells")
    sizes, radii = np.zeros(len(chosen), dtype="int64"), np.zeros(len(chosen))
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return Cells(chosen, rows, sizes, radii)


_VISIT = "query_id LONG, embedding ARRAY<DOUBLE>, cell INT"


def _visits(queries: DataFrame, choose) -> DataFrame:
    """A row per query and cell that ``choose(matrix, batch)`` marks."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                query, cell = np.nonzero(choose(_matrix(b.column("embedding"), spare=1), b))
                at = pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [b.column("query_id").take(at), b.column("embedding").take(at), pa.array(cell, "int32")],
                    names=["query_id", "embedding", "cell"])

    return queries.mapInArrow(run, _VISIT)


def _search(cells: Cells, visits: DataFrame, k: int, shares: int) -> DataFrame:
    """The k best of each visited block.  Rows of a cell meet its queries in blocks of bounded size on
    both sides, so a large cell or one that all queries visit is spread over many tasks."""
    spark = visits.sparkSession
    blocks = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(cells.blocks)], "cell INT, blocks INT"))
    rows = cells.rows.join(blocks, "cell").select(
        "id", "embedding", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    asked = visits.join(blocks, "cell").select(
        "query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share"))
    wanted = asked.select("cell").distinct()

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], "int64"), "id": pa.array([], "int64"), "score": pa.array([], "float64")})
        best = _best(right.column("query_id").to_numpy(), _matrix(right.column("embedding"), spare=1),
                     left.column("id").to_numpy(), _matrix(left.column("embedding")), k)
        return pa.Table.from_batches([best])

    by = ["cell", "block", "share"]
    return rows.join(wanted, "cell", "left_semi").groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(block, _OUT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    # two steps: a query asked of many blocks gets k rows from each, which are thinned side by side first
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("id"), F.lit(MERGES))).orderBy(F.desc("score"), "id")
    thinned = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("rank")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return thinned.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def _nearest_cells(cells: Cells, k: int):
    """The nearest cells of a query that hold k rows together."""
    pivots, sizes = cells.pivots, cells.sizes

    def choose(matrix, _):
        order = np.argsort(_apart(matrix, pivots), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        marks = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(marks, order, (before < k) & (sizes[order] > 0), axis=1)
        return marks
    return choose


def _reachable_cells(cells: Cells, k: int):
    """The other cells that may hold a row as near as the k-th found so far: by the triangle inequality a
    cell's rows are no nearer than its pivot less its radius."""
    first, pivots, sizes, radii = _nearest_cells(cells, k), cells.pivots, cells.sizes, cells.radii

    def choose(matrix, batch):
        kth = batch.column("kth").to_numpy(zero_copy_only=False).astype("float64")
        limit = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.where(np.isnan(kth), -2.0, kth)))
        near = _apart(matrix, pivots) - radii <= limit[:, None] + 1e-7
        return near & (sizes > 0) & ~first(matrix, batch)
    return choose


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int, cells: Cells | None = None) -> DataFrame:
    """The ``k`` most similar rows of ``corpus(id, embedding)`` for each of
    ``queries(query_id, embedding)``, ranked, ties by smaller id; exact.

    Each query first looks at its nearest cells until they hold k rows.  Its k-th score then tells which
    other cells can still matter; the rest are never compared.  Nothing depends on how many queries
    there are.  Vectors that are NULL take no part, a zero vector scores 0.
    """
    cells = cells or in_cells(corpus)
    asked = pinned(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                   .filter("embedding IS NOT NULL"), "queries")
    shares = max(1, math.ceil(asked.count() / QUERIES_PER_BLOCK))
    first = pinned(_ranked(_search(cells, _visits(asked, _nearest_cells(cells, k)), k, shares), k), "first")
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    more = _visits(asked.join(kth, "query_id", "left"), _reachable_cells(cells, k))
    return _ranked(first.drop("rank").unionByName(_search(cells, more, k, shares)), k)


def compared_share(corpus: DataFrame, queries: DataFrame, k: int) -> float:
    """The part of all pairs of query and row that ``cosine_topk`` compares."""
    cells = in_cells(corpus)
    first = _visits(queries, _nearest_cells(cells, k))
    found = _ranked(_search(cells, first, k, 1), k)
    kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    more = _visits(queries.join(kth, "query_id", "left"), _reachable_cells(cells, k))
    visits = {r["cell"]: r["n"] for r in first.unionByName(more).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    return float(sum(n * cells.sizes[c] for c, n in visits.items()) / (queries.count() * cells.sizes.sum()))


def retrieval_context(topk: DataFrame, texts: DataFrame, sep: str = "\n\n") -> DataFrame:
    """The texts found for each query as one string in rank order (k texts per query).

    The ranks are stored first: their file size is known then, so a short list is sent to the
    texts and no text is shuffled but those found.
    """
    found = pinned(topk, "topk").join(texts, "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), sep).alias("context"))
