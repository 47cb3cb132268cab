"""Boosted regression trees from histograms over blocks of binned rows.

The method is that of Spark's ``GBTRegressor`` (squared error, 32 bins per feature, the split with the
greatest gain in variance, a first tree of weight 1 and others of the step size), and its model is what
comes out.  Rows are held otherwise: a byte per feature and eight for what the trees still miss, packed
in blocks, where Spark's fit keeps objects of some 300 bytes per row and, when they outgrow the memory,
writes and reads them at every level of every tree.  Thresholds come from all rows, not from a sample.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

KEPT = 2_048                   # values per feature of a summary: thinning it moves a rank by 1/2048 of the rows at most
TOGETHER = 16                  # summaries made one at once, so that few of those moves add up
SUMMED_ROWS = 65_536           # rows that are summarised, or packed, at once
BLOCK_BYTES = 1 << 18          # of a stored block
STORED = StorageLevel.DISK_ONLY          # in memory Spark keeps blocks in pieces of 1 MB, for which G1 takes 2 MB of a small heap
PACKED = ["codes", "missed"]
SAME = 1e-9                    # means closer than that, and gains, are told apart by rounding alone


def _gathered(batches):
    """The columns of about ``SUMMED_ROWS`` rows at a time, NULLs as NaN."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= SUMMED_ROWS:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, rows = [], 0
    if rows:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _thinned(values, counts):
    """Of more than ``KEPT`` sorted values some stand for those below them, with their counts."""
    if len(values) <= KEPT:
        return values, counts
    total = np.cumsum(counts)
    group = np.ceil(total * (KEPT / total[-1]))
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    return values[ends], np.diff(total[ends], prepend=0)


def _merged(parts):
    """One summary of all parts: rows, and per feature values with their counts."""
    out = []
    for each in zip(*[features for _, features in parts]):
        values, at = np.unique(np.concatenate([v for v, _ in each]), return_inverse=True)
        out.append(_thinned(values, np.bincount(at, np.concatenate([n for _, n in each]), len(values))))
    return sum(rows for rows, _ in parts), out


def _joined(a, b):
    return a + b if len(a) + len(b) <= TOGETHER else [_merged(a + b)]


def _summary(batches):
    parts = []
    for *features, target in _gathered(batches):
        if np.isnan(target).any():
            raise ValueError("a training row without a target")
        part = len(target), [_thinned(*np.unique(x[~np.isnan(x)], return_counts=True)) for x in features]
        parts = _joined(parts, [part])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_merged(parts))], pa.binary())], names=["summary"])


def _edges(values, counts, bins: int) -> np.ndarray:
    """Thresholds between values: all of them, or those nearest to equal shares of the rows."""
    between = values[:-1] / 2 + values[1:] / 2
    if len(between) >= bins:
        total, stride = np.cumsum(counts), counts.sum() / bins
        chosen, goal = [], stride
        for i in range(1, len(values)):
            if abs(total[i - 1] - goal) < abs(total[i] - goal):
                chosen.append(i - 1)
                goal += stride
        between = between[chosen[:bins - 1]]
    return between[~np.isnan(between)]


def _reduced(parts: RDD, add):
    """One result of all tasks; from many of them it is made in two steps, so that few come to the driver."""
    return parts.treeReduce(add, depth=1 if parts.getNumPartitions() <= 64 else 2)


def thresholds(rows: DataFrame, bins: int) -> tuple[int, list[np.ndarray]]:
    """Number of rows and thresholds per feature of ``rows``: the features, then the target, as doubles."""
    found = rows.mapInArrow(_summary, "summary BINARY").rdd.map(lambda r: [pickle.loads(bytes(r[0]))])
    try:
        total, parts = _merged(_reduced(found, _joined))
    except ValueError as e:
        raise ValueError("no training rows") from e
    return total, [_edges(*x, bins) for x in parts]


def packed(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """A row per block: its codes, feature by feature, and its targets."""
    def pack(batches):
        size = max(1, BLOCK_BYTES // (len(edges) + 8))
        for *features, target in _gathered(batches):
            codes = np.stack([np.searchsorted(e, x).astype(np.uint8) for e, x in zip(edges, features)])
            target = target.astype(np.float64)
            for i in range(0, len(target), size):
                block = codes[:, i:i + size].tobytes(), target[i:i + size].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=PACKED)

    return rows.mapInArrow(pack, "codes BINARY, missed BINARY")


def _opened(row):
    missed = np.frombuffer(row[1], np.float64)
    return np.frombuffer(row[0], np.uint8).reshape(-1, len(missed)), missed


def _places(codes, levels) -> np.ndarray:
    """Per row its node after ``levels`` of splits, counted from the left.  A leaf sends all rows to the left."""
    at = np.zeros(codes.shape[1], np.min_scalar_type(2 << len(levels)))
    for splits in levels:
        right = np.zeros(codes.shape[1], bool)
        for j, split in enumerate(splits):
            if split is not None:
                right |= (at == j) & (codes[split[0]] > split[1])
        at = at * at.dtype.type(2) + right
    return at


def _histograms(levels, bins: int, squares: bool):
    """Rows and sums, with ``squares`` also sums of squares, by node, feature and bin.  Two features are
    counted as one with ``bins`` times ``bins`` values, which takes half as many passes."""
    nodes = 2 ** len(levels)

    def run(blocks):
        total = None
        for codes, missed in blocks:
            first = _places(codes, levels).astype(np.intp) * (bins * bins)
            weights = [None, missed, missed * missed][:3 if squares else 2]
            if total is None:
                total = np.zeros((len(weights), -(-len(codes) // 2), nodes * bins * bins))
            for f in range(0, len(codes), 2):
                cell = first + codes[f].astype(np.uint16) * bins
                if f + 1 < len(codes):
                    cell += codes[f + 1]
                for kind, w in zip(total, weights):
                    kind[f // 2] += np.bincount(cell, w, nodes * bins * bins)
        if total is not None:
            cells = total.reshape(len(total), -1, nodes, bins, bins)
            each = np.stack([cells.sum(axis=-1), cells.sum(axis=-2)], axis=2)       # of both features of a pair
            yield each.reshape(len(total), -1, nodes, bins)[:, :len(codes)].swapaxes(1, 2)

    return run


def _best(counts, sums, edges):
    """``feature, bin, gain`` of a node's best split, None for a leaf: ``counts`` and ``sums`` by feature and bin."""
    found, all_rows = [], counts[0].sum()
    for f, e in enumerate(edges):
        n, s = np.cumsum(counts[f])[:len(e)], np.cumsum(sums[f])[:len(e)]
        m, t = all_rows - n, sums[f].sum() - s
        with np.errstate(invalid="ignore", divide="ignore"):
            low, high = s / n, t / m
            apart = (n > 0) & (m > 0) & (np.abs(low - high) > SAME * (np.abs(low) + np.abs(high)))
            gain = np.where(apart, n * m * (low - high) ** 2, 0.0) / max(all_rows, 1.0) ** 2
        found += [(f, b, g) for b, g in enumerate(gain.tolist()) if g > 0]
    most = max((g for _, _, g in found), default=0.0)
    return next((x for x in found if x[2] >= most * (1 - SAME)), None)


@dataclass(frozen=True)
class Tree:
    """Per level the splits from left to right (None for a leaf or what lies below one), and rows, sum and
    sum of squares of what ends in each place below the last level."""

    levels: list[list[tuple[int, int, float] | None]]
    ends: np.ndarray

    @property
    def values(self) -> np.ndarray:
        return self.ends[1] / np.maximum(self.ends[0], 1)


def _grown(blocks: RDD, edges: list[np.ndarray], depth: int, bins: int) -> Tree:
    levels = []
    for level in range(max(depth, 1)):
        stats = _reduced(blocks.mapPartitions(_histograms(levels, bins, level >= depth - 1)), np.add)
        last = levels[-1] if levels else [True]      # below a leaf nothing is split
        levels.append([_best(stats[0, j], stats[1, j], edges) if depth and last[j // 2] is not None else None for j in range(2 ** level)])
    ends = []
    for j, split in enumerate(levels[-1]):
        whole = stats[:, j, 0].sum(axis=-1)
        low = whole if split is None else stats[:, j, split[0], :split[1] + 1].sum(axis=-1)
        ends += [low, whole - low]
    return Tree(levels, np.stack(ends, axis=1))


def _less(tree: Tree, grow: float, weight: float):
    """A block with ``grow`` times what it missed, less ``weight`` times what the tree says."""
    levels, values = tree.levels, tree.values * weight

    def run(block):
        codes, missed = block
        return codes, missed * grow - values.take(_places(codes, levels))

    return run


def boosted(blocks: DataFrame, edges: list[np.ndarray], trees: int, depth: int, step: float, bins: int) -> list[Tree]:
    """Each tree is fitted to twice the error that those before it leave, the first one to the target."""
    held = [blocks.rdd.map(_opened).persist(STORED)]
    made = []
    try:
        for i in range(trees):
            made.append(_grown(held[-1], edges, depth, bins))
            while len(held) > 1:                # its successor is stored by now
                held.pop(0).unpersist()
            if i + 1 < trees:
                less = _less(made[-1], 2.0, 2.0) if i == 0 else _less(made[-1], 1.0, 2.0 * step)
                held.append(held[-1].map(less).persist(STORED))
    finally:
        for x in held:
            x.unpersist()
    return made
