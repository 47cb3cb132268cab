"""Removal of repeated byte strings, by bucket refinement over the positions of a corpus.

Bucket-pointer refinement sorts suffixes by their first q bytes and then refines each bucket by the
buckets that its suffixes reach at later offsets.  Here a bucket's identifier is a hash of the
string that all its suffixes begin with, so the identifier at a later offset is read off the text
instead of a shared position table, and only as many bytes as the asked length are refined.

1. Initial buckets: of the q-grams in a string of the asked length the one with the least hash is
   its anchor.  Equal strings have equal anchors at equal offsets, so only anchors are bucketed; a
   string whose anchor is alone in its bucket is unique and leaves the work.  Strings that follow
   each other and share an anchor form a segment.
2. A bucket is refined by the identifiers at the offsets of its segments' ends: q, 2q and so on are
   pointers, joined pair by pair (``_Block.string_ids``).  Segments of one refined bucket are equal
   as a whole: all but the first are covered at once.  Of the firsts only those go on whose half of
   the asked length before or behind the anchor has a companion in the bucket.
3. They are refined string by string, by pointers reused the same way.

Both refinements shuffle by bucket and read it in sorted order as a stream, so a bucket needs no
memory; equal rows of one task are combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from weir.llm.common import pinned
from weir.llm.workers import give_back, make_room

Q = 32                          # bytes of the initial buckets
BLOCK = 1 << 17                 # bytes hashed at a time
HELD = 50_000                   # segments of one bucket that are looked at together
_PLACE = 25                     # low bits of a place that hold the text's digest
_INDEX = np.uint64((1 << 24) - 1)
_SIZE = (1 << 7) - 1             # low bits of a size that hold the number of strings
_BEHIND, _BEFORE = 1 << 7, 1 << 8   # sides on which a segment that goes on has a companion
_ROW = "k1 long, k2 long, doc long, place long, size int"
_NAMES = ["k1", "k2", "doc", "place", "size"]
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of two strings that cover it."""
    return _mixed(_mixed(a) * _U(0xD6E8FEB86659FD93) + b)


class _Hash:
    """Hashes of all substrings of one length: sums of byte values times powers of an odd number."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        n = BLOCK + (1 << 16)
        self.up, self.down = self._powers(base, n), self._powers(pow(base, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def grams(self, data: np.ndarray, q: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=total[1:])
        n = max(0, len(data) - q + 1)
        return _mixed((total[q:q + n] - total[:n]) * self.down[:n])


_HASHES: dict[int, _Hash] = {}


def _hash(seed: int) -> _Hash:
    if seed not in _HASHES:
        _HASHES[seed] = _Hash(seed)
    return _HASHES[seed]


class _Block:
    """Some texts, or parts of long ones, one after the other."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]], length: int):
        self.length = length
        doc, digest, base, texts = zip(*parts)
        self.doc, self.digest, self.base = (np.array(x, dtype=np.int64) for x in (doc, digest, base))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.ends = self.first + sizes
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.grams = _hash(1).grams(self.data, min(Q, length))

    def string_ids(self, at: np.ndarray, grams: np.ndarray | None = None) -> np.ndarray:
        """Identifiers of the strings of the asked length that start at these places: pointers to the
        buckets at later offsets, with the doubled identifiers used again in the next step."""
        grams = self.grams if grams is None else grams
        reached = min(Q, self.length)
        known: dict[tuple[int, int], np.ndarray] = {}

        def identifier(offset: int, size: int) -> np.ndarray:
            key = (offset, size)
            if key not in known:
                if size <= reached:
                    known[key] = grams[at + offset]
                else:
                    half = max(reached, (size + 1) // 2)
                    known[key] = _joined(identifier(offset, half), identifier(offset + size - half, half))
            return known[key]

        return identifier(0, self.length)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def segments(self):
        """Runs of string starts with one anchor: (k1, k2, part, start in the text, number of strings)."""
        n = len(self.data) - self.length + 1
        if n <= 0:
            return None
        width = self.length - min(Q, self.length) + 1
        keyed = (self.grams & ~_INDEX) | np.arange(len(self.grams), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            keyed, span = np.minimum(keyed[:-span], keyed[span:]), 2 * span
        least = np.minimum(keyed[:n], keyed[width - span:width - span + n]) & _INDEX
        inside = np.zeros(n + 1, dtype=np.int8)
        whole = self.ends - self.first >= self.length
        inside[self.first[whole]] += 1
        inside[(self.ends - self.length + 1)[whole]] -= 1
        starts = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8) > 0)
        if not len(starts):
            return None
        anchor = least[starts].astype(np.int64)
        fresh = np.ones(len(starts), dtype=bool)
        fresh[1:] = (np.diff(anchor) != 0) | (np.diff(starts) != 1)
        # two texts can meet without a gap when one is exactly as long as a string
        part = self.owners(starts)
        fresh[1:] |= np.diff(part) != 0
        at = np.flatnonzero(fresh)
        low, size = starts[at], np.diff(np.append(at, len(starts)))
        k2 = _joined(_joined(self.string_ids(low), self.string_ids(low + size - 1)), size.astype(np.uint64))
        return self.grams[anchor[at]], k2, part[at], low, size, self._sides(anchor[at], part[at])

    def _sides(self, anchor: np.ndarray, part: np.ndarray) -> np.ndarray:
        """12 bits of the identifiers behind and before an anchor, above the bits of a size.  Strings
        that two segments share hold half of the bytes beside their anchor on one of its sides; a side
        that the text cuts short has bits of its own."""
        q = min(Q, self.length)
        half = (self.length - q + 1) // 2
        out = np.zeros(len(anchor), dtype=np.int64)
        for shift, offset in ((7, half), (19, -half)):
            other = anchor + offset
            whole = (other >= self.first[part]) & (other + q <= self.ends[part])
            side = _mixed(anchor.astype(np.uint64) + _U(offset % 977))
            side[whole] = _joined(self.grams[anchor[whole]], self.grams[other[whole]])
            out |= (side >> _U(52)).astype(np.int64) << shift
        return out

    def rows(self, k1, k2, part, low, size, sides=0) -> pa.RecordBatch:
        """Rows for the shuffle.  Of equal keys only the first place goes on; the others are covered
        already and go on as marks (negative size), those that touch as one."""
        doc, digest = self.doc[part], self.digest[part]
        start = low - self.first[part] + self.base[part]
        order = np.lexsort((start, doc, k2, k1))
        same = np.zeros(len(order), dtype=bool)
        a, b = order[:-1], order[1:]
        same[1:] = (k1[a] == k1[b]) & (k2[a] == k2[b])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = same & ((doc[order] != doc[head]) | (start[order] != start[head]))
        covered = np.zeros(len(order), dtype=bool)
        covered[order[later]] = True
        kept = ~covered
        spots = np.lexsort((low, part))[covered[np.lexsort((low, part))]]
        merged = np.ones(len(spots), dtype=bool)
        if len(spots) > 1:
            merged[1:] = (part[spots][1:] != part[spots][:-1]) | (low[spots][1:] > (low + size)[spots][:-1])
        heads = spots[merged]
        tails = spots[np.append(np.flatnonzero(merged)[1:] - 1, len(spots) - 1)] if len(spots) else spots
        spans = low[tails] + size[tails] - low[heads]
        place = start << _PLACE | digest
        spread = _mixed((doc[heads] * 31 + start[heads]).astype(np.uint64))
        columns = [
            np.concatenate([k1[kept], spread]).view(np.int64), np.concatenate([k2[kept], spread]).view(np.int64),
            np.concatenate([doc[kept], doc[heads]]), np.concatenate([place[kept], place[heads]]),
            np.concatenate([(size | sides)[kept], -spans]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch], length: int, extra: bool, size: int) -> Iterator[tuple[_Block, list]]:
    """Texts gathered to blocks; texts longer than a block in parts that overlap by a string less one."""
    parts, wanted, gathered = [], [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            doc, digest, text = (batch.column(i)[row].as_py() for i in range(3))
            text = text.encode("utf-8")
            for base in range(0, max(1, len(text) - length + 1), size // 2):
                part = text[base:base + size // 2 + length - 1]
                if gathered and gathered + len(part) > size:
                    yield _Block(parts, length), wanted
                    parts, wanted, gathered = [], [], 0
                parts.append((doc, digest, base, part))
                wanted.append(batch.column(3)[row] if extra else None)
                gathered += len(part)
    if gathered:
        yield _Block(parts, length), wanted


def _segmented(length: int, block_size: int) -> Callable:
    def run(batches):
        make_room()
        for block, _ in _blocks(batches, length, False, block_size):
            found = block.segments()
            if found is not None:
                yield block.rows(*found)
        give_back()

    return run


def _strings(length: int, block_size: int) -> Callable:
    """The strings of the segments asked for, with a key of 128 bits."""
    span = length - min(Q, length)
    half = (span + 1) // 2

    def run(batches):
        make_room()
        for block, wanted in _blocks(batches, length, True, block_size):
            lows, owners = [], []
            for k, asked in enumerate(wanted):
                room = block.ends[k] - block.first[k] - length + 1
                for place, size in zip(asked.values.field("place").to_numpy(), asked.values.field("size").to_numpy()):
                    start = (place >> _PLACE) - block.base[k]
                    low, high = max(0, start), min(room, start + (size & _SIZE), block_size // 2)
                    if low < high and not (size & _BEHIND and size & _BEFORE):
                        # with a companion on one side only, strings hold at least half of that side
                        first = block.first[k] + low
                        anchor = low + int((block.grams[first:first + span + 1] & ~_INDEX).argmin())
                        if size & _BEHIND:
                            low = max(low, anchor - (span - half))
                        else:
                            high = min(high, anchor - half + 1)
                    if low < high:
                        lows.append(np.arange(low, high) + block.first[k])
                        owners.append(np.full(high - low, k))
            if lows:
                at, part = np.concatenate(lows), np.concatenate(owners)
                other = _hash(2).grams(block.data, min(Q, length))
                ones = np.ones(len(at), dtype=np.int64)
                yield block.rows(block.string_ids(at), block.string_ids(at, other), part, at, ones)
        give_back()

    return run


def _refined(split_on: bool) -> Callable:
    """Over rows sorted by (k1, k2, doc, place): marks pass through; of equal (k1, k2) all places but
    the first become marks.  With ``split_on`` the firsts that may share a string with another go on."""

    def run(batches):
        last = None                 # keys and first place of the run that the batch before ended in
        held = [np.zeros(0, dtype=np.int64)] * 5        # firsts of the bucket that may go on
        loose = None                # a bucket too large to be held: all its firsts go on
        for batch in batches:
            k1, k2, doc, place, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            out = [(doc[size < 0], place[size < 0], size[size < 0])]
            rows = np.flatnonzero(size > 0)
            if len(rows):
                k1, k2, doc, place, size = (x[rows] for x in (k1, k2, doc, place, size))
                start = place >> _PLACE
                fresh = np.ones(len(rows), dtype=bool)
                fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
                fresh[0] = last is None or (k1[0], k2[0]) != last[:2]
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), -1))
                first_doc = np.where(head >= 0, doc[head], last[2] if last else 0)
                first_start = np.where(head >= 0, start[head], last[3] if last else 0)
                later = (doc != first_doc) | (start != first_start)
                out.append((doc[later], place[later], -(size[later] & _SIZE)))
                last = (k1[-1], k2[-1], first_doc[-1], first_start[-1])
                if split_on:
                    held = [np.concatenate([h, x[~later]]) for h, x in zip(held, (k1, k2, doc, place, size))]
                    ended = int(np.searchsorted(held[0], k1[-1]))
                    done, held = [x[:ended] for x in held], [x[ended:] for x in held]
                    out.append(_going_on(done, loose))
                    if len(held[0]) > HELD:
                        loose = k1[-1]
                    if loose == k1[-1]:
                        out.append(_going_on(held, loose))
                        held = [x[:0] for x in held]
            yield _marks(out)
        if len(held[0]):
            yield _marks([_going_on(held, loose)])

    return run


def _going_on(firsts: list[np.ndarray], loose) -> tuple[np.ndarray, ...]:
    """Firsts with another one in their bucket that has the same bytes behind or before the anchor."""
    k1, k2, doc, place, size = firsts
    behind, before = _several(k1, k2, size >> 7 & 0xFFF), _several(k1, k2, size >> 19)
    if loose is not None:
        behind |= k1 == loose
        before |= k1 == loose
    go = behind | before
    return doc[go], place[go], ((size & _SIZE) + behind * _BEHIND + before * _BEFORE)[go]


def _several(k1: np.ndarray, k2: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether a row's (k1, side) comes with more than one k2."""
    if not len(k1):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((k2, side, k1))
    a, s, b = k1[order], side[order], k2[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
    ends = np.append(starts[1:], len(a)) - 1
    out = np.empty(len(a), dtype=bool)
    out[order] = np.repeat(b[starts] != b[ends], ends - starts + 1)
    return out


def _marks(parts) -> pa.RecordBatch:
    doc, place, size = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(place), pa.array(size.astype(np.int32))], names=_NAMES[2:])


def _sorted_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("k1").sortWithinPartitions("k1", "k2", "doc", "place")


def _identified(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """Texts with the order of their ids (NULL last) and a digest that tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << _PLACE) - 1)).alias("digest"), text.alias("body"),
        F.struct(F.col(text_col).isNull().alias("_null"), *columns).alias("kept"))


def repeated_spans(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text",
                   columns: list[str] | None = None, block_size: int = BLOCK) -> DataFrame:
    """``docs`` as (``doc``, ``digest``, ``body``, ``kept``: the named columns) with ``spans``, an array of
    (start, size): strings of ``length`` bytes that start at ``start`` and the ``size - 1`` bytes behind
    it also start earlier.  NULL where there are none.

    Both joins with the texts read the same exchange, so texts move once.
    """
    if not 1 <= length < _SIZE + 2:
        raise ValueError(f"strings of 1 to {_SIZE + 1} bytes")
    texts = _identified(docs, id_col, text_col, columns or [])
    plain = texts.select("doc", "digest", "body")
    found = pinned(_sorted_buckets(plain.mapInArrow(_segmented(length, block_size), _ROW)).mapInArrow(
        _refined(True), "doc long, place long, size int"), "buckets")
    digest = F.col("place").bitwiseAND(F.lit((1 << _PLACE) - 1)).alias("digest")
    asked = found.filter("size > 0").groupBy("doc", digest).agg(F.collect_set(F.struct("place", "size")).alias("asked"))
    strings = texts.join(asked, ["doc", "digest"]).select("doc", "digest", "body", "asked", "kept").mapInArrow(
        _strings(length, block_size), _ROW)
    split = _sorted_buckets(strings).mapInArrow(_refined(False), "doc long, place long, size int")
    marks = found.filter("size < 0").union(split)
    span = F.struct(F.shiftright("place", _PLACE).alias("start"), (-F.col("size")).alias("size"))
    spans = marks.groupBy("doc", digest).agg(F.collect_set(span).alias("spans"))
    return texts.join(spans, ["doc", "digest"], "left")


def _covered(spans, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    runs: list[list[int]] = []
    for start, size in sorted(spans):
        end = min(n, start + size + length - 1)
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def _cut(text: str, spans, length: int) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    data = text.encode("utf-8")
    runs = _covered([(s["start"], s["size"]) for s in spans or ()], length, len(data))
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return data, b"".join([*out, data[at:]]), runs


def removal_report(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text",
                   block_size: int = BLOCK) -> DataFrame:
    """Per document the bytes and maximal runs that repeats of ``length`` bytes cover, and the SHA-256
    of what is left: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document of smaller
    id (NULL ids last) or earlier in the same one.  Rows of one id are one document: a string at the
    same start in the other row is not earlier.  NULL and empty texts have no bytes.  Other columns are
    left out.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, left, runs = _cut(text, spans, length)
                out.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            n, gone, runs, sha = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pc.struct_field(batch.column(0), [id_col]), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(sha, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = repeated_spans(docs, length, id_col, text_col, [id_col], block_size)
    # the whole struct: the exchange is shared only if both joins ask for the same columns
    return rows.select("kept", "body", "spans").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text",
                    block_size: int = BLOCK) -> DataFrame:
    """``docs`` with the covered bytes cut out of the text, all columns kept.  A cut can fall inside a
    letter; the letter's remaining bytes go too.  Texts without repeats, NULL among them, stay as they are,
    and so do empty ones.  Of rows that are alike the strings of one are cut out of none: they are one
    document.  Columns may have any names.  An empty table gives no rows."""

    def run(batches):
        for batch in batches:
            texts = [_cut(t, s, length)[1].decode("utf-8", "ignore") if s else t
                     for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["kept", "left"])

    # columns go by number, so that no name can clash or need quotes
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    others = [c for c in plain.columns if c != text]
    rows = repeated_spans(plain, length, own, text, others, block_size).select("kept", "body", "spans")
    changed = rows.mapInArrow(run, StructType([rows.schema["kept"]]).add("left", "string"))
    return changed.select(*[
        F.when(~F.col("kept._null"), F.col("left")).alias(c) if c == text else F.col(f"kept.{c}") for c in plain.columns]).toDF(*docs.columns)
