"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weir.llm import words
from weir.llm.common import ROWS_PER_STEP, pinned, text_or_empty
from weir.llm.workers import give_back

ROWS_PER_RANKING = 10_000      # pieces of one length that one task numbers

_PLAN = "length long, low long, high long, each long, sequence long, used long"


def token_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The ids of every text, ``end_id`` behind them, cut into pieces of at most ``size`` ids:
    ``piece``, ``start``, ``length``, ``ids_crc32`` and, with ``with_ids``, the ``ids`` themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = words.load(vocabulary), words.packed([end_id])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_STEP):
                part, rows = batch.slice(at, ROWS_PER_STEP), []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = bpe.encode(text) + end
                    for k, first in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[first:first + 4 * size]
                        rows.append((row, k, first // 4, len(cut) // 4, zlib.crc32(cut), cut))
                row, k, start, length, crc, cuts = zip(*rows)
                arrays = [part.column(0).take(pa.array(row)), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                          pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = np.cumsum([0, *(len(c) // 4 for c in cuts)])
                    arrays.append(pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(cuts), "<i4"), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, schema)


def best_fit_plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, low, high, each, sequence, used)``.

    The pieces of ``length`` with ranks from ``low`` to below ``high`` go to sequences from ``sequence``
    on, ``each`` of them per sequence, behind the ``used`` tokens there.  Sequences with the same room
    are kept as ranges, so the work depends on the number of lengths, not on that of pieces: a length
    adds at most three ranges, and a range takes pieces of fewer than sqrt(2 size) lengths, as their
    sum is at most ``size``.  For 2048 that bounds the plan by some 400,000 rows whatever the input.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    plan, opened = [], 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in room:
                room[free] = []
                insort(sizes, free)
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                n = math.ceil(left / (size // length))
                put(size, opened, n)
                opened += n
                continue
            free = sizes[at]
            first, n = room[free].pop()
            if not room[free]:
                del room[free]
                sizes.pop(at)
            each = min(free // length, left)
            filled = min(n, left // each)
            plan.append((length, rank, rank + filled * each, each, first, size - free))
            put(free - each * length, first, filled)
            put(free, first + filled, n - filled)
            rank, left = rank + filled * each, left - filled * each
    return plan


def pack(pieces: DataFrame, size: int, order: list[str], rows_per_ranking: int = ROWS_PER_RANKING) -> DataFrame:
    """``pieces`` (stored, column ``length`` from 1 to ``size``) with ``sequence_id`` and ``offset``.

    Only the histogram of lengths, at most ``size`` rows, comes to the driver; the plan goes back as a
    table of bounded size.  Each piece takes the slot of its rank among pieces of its length.  Ranks are
    counted in shares: a length's rows are dealt over as many shares as its count asks for, numbered in
    each, and begin behind the rows of the shares before.  Rows alike in ``order`` are interchangeable.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = F.broadcast(spark.createDataFrame(best_fit_plan(histogram, size), _PLAN))
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_per_ranking = min(rows_per_ranking, max(500, sum(histogram.values()) // tasks))
    dealt = F.broadcast(spark.createDataFrame(
        [(n, math.ceil(c / rows_per_ranking)) for n, c in histogram.items()], "length long, shares long"))
    share = F.pmod(F.xxhash64(*order), F.col("shares")).alias("share")
    rows = pieces.join(dealt, "length").select(*pieces.columns, share)
    counts = pinned(rows.groupBy("length", "share").count(), "shares")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pinned(counts.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")),
                     "offsets")
    own = Window.partitionBy("length", "share").orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["length", "share"]).withColumn(
        "rank", F.col("rank") + F.col("before"))
    placed = ranked.join(plan, "length").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *pieces.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("used") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, size: int, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every text encoded, cut where longer than ``size``, and packed into sequences of ``size`` tokens.

    NULL and empty texts are one piece, the end id.  Repeated rows are packed each, a NULL id is kept.
    Other columns are left out, so names cannot clash.  An empty table gives no rows.  The pieces are
    written to the shared folder; texts are not shuffled.
    """
    pieces = pinned(token_pieces(docs, vocabulary, size, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, size, [id_col, "piece", "start", "ids_crc32"])
