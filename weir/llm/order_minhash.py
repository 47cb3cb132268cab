"""Order MinHash fingerprints of texts: minimal numbered k-mers in text order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weir.llm.common import per_text, pinned, text_or_empty

K = 9                          # code points of a k-mer
TUPLE = 2                      # k-mers of a tuple
TUPLES = 64                    # tuples of a fingerprint
PREFIX = 64                    # code points of a text by which rows of one id are dealt
_STEP = 4096                   # k-mers hashed at a time
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 32, TUPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-mer (of the whole text, if it is shorter), by doubling."""
    k = min(k, len(points))
    known, size = _mixed(points + _U(0x9E3779B97F4A7C15)), 1
    while 2 * size <= k:
        known, size = _mixed(known[:-size] * _U(0xBF58476D1CE4E5B9) + known[size:]), 2 * size
    if size < k:
        shift = k - size
        known = _mixed(known[:-shift] * _U(0xBF58476D1CE4E5B9) + known[shift:])
    return known


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer hash with the number of equal ones before it mixed in."""
    n = len(kmers)
    places = max(1, (n - 1).bit_length())
    keyed = np.sort(kmers >> _U(places) << _U(places) | np.arange(n, dtype=np.uint64))
    place, group = (keyed & _U((1 << places) - 1)).astype(np.int64), keyed >> _U(places)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = group[1:] != group[:-1]
    index = np.arange(n)
    out = np.empty(n, dtype=np.uint64)
    out[place] = (index - np.maximum.accumulate(np.where(fresh, index, 0))).astype(np.uint64)
    return _mixed(kmers + out * _U(0x94D049BB133111EB))


def fingerprint(text: str, k: int = K, size: int = TUPLE) -> np.ndarray:
    """The hash of each tuple, 16 bits: per hash function the ``size`` k-mers with the least hashes, with
    the number of their occurrence, in text order.  An empty text has all zeros."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(TUPLES, dtype=np.uint16)
    named = _numbered(_kmers(points, k))
    short = (named >> _U(32)).astype(np.uint32)
    best_hash = best_place = None
    for at in range(0, len(short), _STEP):
        hashes = _MULTIPLIERS[:, None] * short[None, at:at + _STEP]
        found_hash, found_place = [], []
        lines = np.arange(TUPLES)
        for _ in range(min(size, hashes.shape[1])):
            least = hashes.argmin(axis=1)
            found_hash.append(hashes[lines, least].astype(np.uint64))
            found_place.append(least + at)
            hashes[lines, least] = np.uint32(0xFFFFFFFF)
        new_hash, new_place = np.stack(found_hash, axis=1), np.stack(found_place, axis=1)
        if best_hash is not None:
            new_hash, new_place = np.hstack([best_hash, new_hash]), np.hstack([best_place, new_place])
            order = np.argsort(new_hash, axis=1, kind="stable")[:, :size]
            new_hash, new_place = np.take_along_axis(new_hash, order, 1), np.take_along_axis(new_place, order, 1)
        best_hash, best_place = new_hash, new_place
    out = np.full(TUPLES, size, dtype=np.uint64)
    for column in np.sort(best_place, axis=1).T:
        out = _mixed(out * _U(0xBF58476D1CE4E5B9) + named[column])
    return (out >> _U(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples."""
    return float(np.mean(a == b))


def written(values: np.ndarray) -> str:
    """A fingerprint as text, 4 hexadecimal digits a tuple."""
    return values.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = TUPLE) -> DataFrame:
    """``(id, n_chars, fingerprint)`` of every row, row-local.  NULL and empty texts have a fingerprint of
    zeros, texts shorter than a k-mer are one k-mer; equal texts have equal fingerprints."""
    return per_text(docs, [id_col], text_col, "n_chars long, fingerprint string",
                    lambda: lambda text: (len(text), written(fingerprint(text, k, size))))


_REPORT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(text: str, own: np.ndarray, following: str, next_print: np.ndarray, k: int, size: int) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed, k, size)
    return (len(text), hashlib.sha256(changed.encode("utf-8")).digest(), bytes.fromhex(written(own)), bytes.fromhex(written(other)),
            likeness(own, other), likeness(own, next_print))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = TUPLE) -> DataFrame:
    """Fingerprints of every text and of an edited one: its second half replaced by the beginning of the
    next document (ascending id; after the last comes the first), and the likeness of the text to both.

    NULL texts are empty.  Rows of one id are one document, whose least text stands for it as a next
    one; NULL ids come last.  A table of one id is its own next.  Other columns are left out; an empty
    table gives no rows.  Texts move once, dealt by ranges of ids and read in order; only the rows at
    the ends of the ranges are stored and matched with the range behind.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    place = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    dealt = docs.select(F.col(id_col).alias("id"), place.alias("place"), text_or_empty(text_col).alias("body"))
    dealt = dealt.repartitionByRange("place", F.substring("body", 1, PREFIX)).sortWithinPartitions("place", "body")
    edge = "edge int, place long, body string"
    names = ["id", "edge", "place", "body", *[c.split()[0] for c in _REPORT.split(", ")]]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def batch_of(ids: list, id_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []           # rows of one id whose next text is still to come
        none, begun, id_type = (None,) * 6, [], None
        for batch in batches:
            ids, out, id_type = [], [], batch.column(0).type
            for doc, at, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                # the first id may go on from the range before, whose last rows then ask for the second
                if len(begun) < 2 and at not in begun:
                    begun.append(at)
                    ids.append(doc)
                    out.append((1, at, text, *none))
                own = fingerprint(text, k, size)
                if waiting and waiting[0][1] != at:
                    for before, _, body, print_ in waiting:
                        ids.append(before)
                        out.append((0, None, None, *_compared(body, print_, text, own, k, size)))
                    waiting = []
                waiting.append((doc, at, text, own))
            if out:
                yield batch_of(ids, id_type, out)
        if waiting:
            yield batch_of([w[0] for w in waiting], id_type, [(2, w[1], w[2], *none) for w in waiting])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compared(t, fingerprint(t, k, size), n, fingerprint(n, k, size), k, size)
                    for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types[3:])]], names=["id", *names[4:]])

    found = pinned(dealt.mapInArrow(stream, f"id {kind}, {edge}, {_REPORT}"), "compared")
    heads = found.filter("edge = 1").groupBy(F.col("place").alias("next")).agg(F.min("body").alias("following"))
    tails = found.filter("edge = 2").select("id", "place", "body")
    # three ids a range: their order is that of the ranges
    ends = found.filter("edge > 0").groupBy("place").agg(F.min(F.when(F.col("edge") == 1, F.col("place"))).alias("head"))
    ahead = Window.orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    following = ends.select("place", F.coalesce(F.min("head").over(ahead), F.min("head").over(Window.partitionBy())).alias("next"))
    last = tails.join(following, "place").join(heads, "next").select("id", "body", "following")
    done = found.filter("edge = 0").select("id", *names[4:]).union(last.mapInArrow(finish, f"id {kind}, {_REPORT}"))
    return done.select(F.col("id").alias(id_col), *[
        F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in map(str.split, _REPORT.split(", "))])
