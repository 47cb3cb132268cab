"""Packing by lexical retrieval: each sequence holds a seed document and its nearest unused neighbours.

Document frequencies are counted over all documents; they are one number per entry of the vocabulary,
so every task can hold them.  Documents are dealt by ranges of their two rarest terms to tasks
of some two million tokens; a task builds one shard of the inverted index after the other.  A seed's
terms are looked up in the shard's postings, BM25 scores are summed, and the neighbours not used yet
fill the seed's window, best first.  The one that does not fit is cut there, and its rest is the next
seed.  A task's last window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import gc
import json
import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers.models import BPE

from weir.llm import words
from weir.llm.common import pinned, text_or_empty

K1, B = 1.2, 0.75
TASK_TOKENS = 1 << 21           # tokens that one task packs
SHARD_DOCS = 512                # documents of one shard of the index
KNOWN_CHUNKS = 700_000         # chunks of each half of the table: some 350 MB in all
STEP_BYTES = 1 << 24            # bytes of texts whose chunks are looked up together
_OTHER_SPACES = "\x1c\x1d\x1e\x1f"
_MAYBE_ODD = f"<\\||[{_OTHER_SPACES}\u0130\u0300-\U0010ffff]"      # texts that are looked at one by one
_DOCS, _TOKENS = -1, -2         # rows of the counts that are not terms


class _Chunks(dict):
    """The ids of chunks between white space.  When full it becomes the older half, whose chunks come back
    when they are asked for; so frequent ones stay and memory is bounded."""

    def __init__(self, vocabulary: str, bpe: words.WordBpe, limit: int = KNOWN_CHUNKS):
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        # without a cache of its own: what comes here has not been seen
        self.model = BPE(vocab=bpe.vocab, merges=pairs, end_of_word_suffix=bpe.end, cache_capacity=0)
        self.written = [words.packed([i]) for i in range(max(bpe.vocab.values(), default=0) + 1)]
        self.pieces, self.limit, self.older = bpe.near.findall, limit, {}

    def _word(self, word: str) -> bytes:
        written = self.written
        return b"".join([written[t.id] for t in self.model.tokenize(words.byte_mapped(word))])

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self._word(chunk)
            elif chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                ids = self[chunk[:-1]] + self[chunk[-1]]
            else:
                pieces = self.pieces(chunk)
                ids = self._word(chunk) if pieces == [chunk] else b"".join([self[p] for p in pieces])
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(chunk) <= 200:
            self[chunk] = ids
        return ids


class _Encoder:
    """Ids by way of chunks between white space, which the vocabulary never joins."""

    _loaded: dict[str, "_Encoder"] = {}

    def __init__(self, vocabulary: str):
        self.bpe = words.load(vocabulary)
        self.chunk_ids = _Chunks(vocabulary, self.bpe).__getitem__
        # kept as long as the worker: collections of garbage need not look through the tables each time
        gc.freeze()

    @classmethod
    def load(cls, vocabulary: str) -> "_Encoder":
        """One instance per Python worker and file."""
        if vocabulary not in cls._loaded:
            cls._loaded[vocabulary] = cls(vocabulary)
        return cls._loaded[vocabulary]

    def encode(self, text: str) -> bytes:
        if not self.bpe._plain(text) or any(c in text for c in _OTHER_SPACES):
            return self.bpe.encode(text)
        return b"".join(map(self.chunk_ids, text.lower().split()))

    def encode_all(self, texts: pa.Array, end_id: int, width: int) -> pa.Array:
        """The ids of every text, ``end_id`` behind them, ``width`` bytes each.

        The texts are split together and each of their different chunks is looked up once.  A text that
        may need more than lower-casing is left empty here and counts as one chunk behind the split.
        """
        odd = pc.match_substring_regex(texts, _MAYBE_ODD)
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, pa.scalar("", texts.type), texts)))
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        found = split.flatten().dictionary_encode()
        del split
        known = [*map(self.chunk_ids, found.dictionary.to_numpy(zero_copy_only=False)), words.packed([end_id])]
        end = len(known) - 1
        known += [self.encode(t) for t in texts.take(pa.array(alone)).to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4 * width
        joined = np.frombuffer(b"".join(known), "<u4").astype(f"<u{width}")
        table = pa.Array.from_buffers(pa.binary(), len(known), [None, _offsets(sizes), pa.py_buffer(joined)])
        del known
        # behind the chunks of each text, or the text alone, stands its end
        codes = np.insert(found.indices.to_numpy(), np.concatenate([ends[alone], ends]),
                          np.concatenate([np.arange(end + 1, end + 1 + len(alone)), np.full(len(texts), end)]))
        ends += np.searchsorted(alone, np.arange(len(texts)), side="right") + np.arange(1, len(texts) + 1)
        del found
        ids = table.take(pa.array(codes))
        at = np.frombuffer(ids.buffers()[1], np.int32)[np.append(0, ends)]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), ids.buffers()[2]])


def _offsets(sizes: np.ndarray) -> pa.Buffer:
    return pa.array(np.append(0, np.cumsum(sizes)), pa.int32()).buffers()[1]


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to where the texts before add up to another ``STEP_BYTES``."""
    if len(texts):
        steps = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // STEP_BYTES
        bounds = [0, *(np.flatnonzero(steps[1:] != steps[:-1]) + 1).tolist(), len(texts)]
        yield from pairwise(bounds)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every text and ``end_id`` behind them, two bytes each where they fit (``tokens``)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.load(vocabulary)
        width = _width(max(encoder.bpe.vocab.values()) if encoder.bpe.vocab else 0, end_id)
        for batch in batches:
            for first, last in _steps(batch.column(1)):
                part = batch.slice(first, last - first)
                tokens = encoder.encode_all(part.column(1), end_id, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), tokens, pa.array(np.full(len(tokens), width, np.int32))],
                    names=["id", "tokens", "width"])

    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"id {kind}, tokens binary, width int")


def _width(*largest: int) -> int:
    return 2 if max(largest) < 1 << 16 else 4


def _ids(tokens: bytes, width: int) -> np.ndarray:
    return np.frombuffer(tokens, f"<u{width}")


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and how often each stands."""
    if not len(ids):
        return ids, np.zeros(0, dtype=np.int64)
    ordered = np.sort(ids, kind="stable")          # by radix for two bytes
    bounds = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
    return ordered[bounds[:-1]], bounds[1:] - bounds[:-1]


def _document_counts(stored: DataFrame) -> DataFrame:
    """In how many documents each term stands, and how many documents and tokens there are: every task
    adds up its own, a row per term goes to the shuffle."""
    schema = _arrow("term int, docs long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, total = np.zeros(1 << 16, dtype=np.int64), 0, 0
        for batch in batches:
            for tokens, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _ids(tokens, width)[:-1]
                docs, total = docs + 1, total + len(ids)
                terms, _ = _terms(ids)
                if len(terms) and terms[-1] >= len(seen):
                    seen = np.concatenate([seen, np.zeros(int(terms[-1]) + 1, dtype=np.int64)])
                seen[terms] += 1
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[_DOCS, _TOKENS], terms]), pa.int32()),
             pa.array(np.concatenate([[docs, total], seen[terms]]), pa.int64())], schema=schema)

    return stored.select("tokens", "width").mapInArrow(run, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


class Statistics:
    """What BM25 needs of the corpus: one number per term, and the mean length."""

    def __init__(self, counts: dict[int, int]):
        self.docs, total = counts.get(_DOCS, 0), counts.get(_TOKENS, 0)
        self.total = total + self.docs
        self.mean = max(total / max(self.docs, 1), 1.0)
        size = max([t for t in counts if t >= 0], default=0) + 1
        self.seen = np.zeros(size, dtype=np.int64)
        for term, n in counts.items():
            if term >= 0:
                self.seen[term] = n
        self.rarity = np.log1p((self.docs - self.seen + 0.5) / (self.seen + 0.5))

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a document and their BM25 weights in it."""
        terms, times = _terms(ids)
        damped = times * (K1 + 1) / (times + K1 * (1 - B + B * len(ids) / self.mean))
        return terms, self.rarity[terms] * damped


def _with_leads(stored: DataFrame, statistics: Statistics) -> DataFrame:
    """The two rarest terms that other documents hold too; -1 where there are none."""
    kind = stored.schema["id"].dataType.simpleString()
    schema = f"id {kind}, tokens binary, width int, lead int, second int"
    worth = np.where(statistics.seen > 1, statistics.rarity, -1.0)

    def rarest(ids: np.ndarray) -> tuple[int, int]:
        values, found = worth[ids], []
        for _ in range(2):
            at = int(values.argmax()) if len(values) else -1
            if at < 0 or values[at] < 0:
                return (*found, -1, -1)[:2]
            found.append(int(ids[at]))
            values[ids == ids[at]] = -1.0
        return tuple(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = [rarest(_ids(t, w)[:-1]) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in leads], pa.int32()), pa.array([b for _, b in leads], pa.int32())],
                names=["id", "tokens", "width", "lead", "second"])

    return stored.mapInArrow(run, schema)


class Shard:
    """An inverted index of some documents: postings by term, with their BM25 weights."""

    def __init__(self, documents: list[np.ndarray], statistics: Statistics):
        found = [statistics.weights(ids) for ids in documents]
        self.terms = [t for t, _ in found]
        sizes = [len(t) for t in self.terms]
        every = np.concatenate(self.terms) if found else np.zeros(0, dtype=np.int64)
        order = np.argsort(every, kind="stable")
        self.doc = np.repeat(np.arange(len(found)), sizes)[order]
        self.weight = np.concatenate([w for _, w in found])[order] if found else np.zeros(0)
        self.named, first = np.unique(every[order], return_index=True)
        self.bounds = np.append(first, len(every))
        self.unused = np.ones(len(found), dtype=bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """The documents not used yet, by BM25 score with the seed's terms as query, ties by place."""
        at = np.searchsorted(self.named, self.terms[seed])
        first, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        places = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        scores = np.bincount(self.doc[places], weights=self.weight[places], minlength=len(self.unused))
        free = np.flatnonzero(self.unused)
        return free[np.argsort(-scores[free], kind="stable")]

    def shrink(self) -> None:
        """Take the postings of used documents out."""
        kept = self.unused[self.doc]
        self.bounds = np.append(0, np.cumsum(kept))[self.bounds]
        self.doc, self.weight = self.doc[kept], self.weight[kept]


class _Windows:
    """Windows filled one after the other; only the open one is held."""

    def __init__(self, size: int, first: int):
        self.size, self.number = size, first
        self.open: list[tuple] = []            # (document, start, length)
        self.used = 0

    def put(self, document, start: int, end: int) -> tuple[list[tuple], int]:
        """As much of a document as fits: closed pieces, and where its rest starts."""
        length = min(end - start, self.size - self.used)
        self.open.append((document, start, length))
        self.used += length
        return (self._close(self.size) if self.used == self.size else []), start + length

    def _close(self, size: int) -> list[tuple]:
        """Pieces (document, start, length, sequence, offset) of the first ``size`` tokens held."""
        out, at = [], 0
        while at < size:
            document, start, length = self.open.pop(0)
            taken = min(length, size - at)
            out.append((document, start, taken, self.number, at))
            at += taken
            if taken < length:
                self.open.insert(0, (document, start + taken, length - taken))
        self.number, self.used = self.number + 1, self.used - size
        return out

    def rest(self) -> list[tuple]:
        """The open window, cut into powers of two."""
        out = []
        while self.used:
            out += self._close(1 << (self.used.bit_length() - 1))
        return out


def _fill(windows: _Windows, documents: list[tuple], statistics: Statistics) -> Iterator[list[tuple]]:
    """The pieces of a shard's documents ``(id, ids)``, in the order in which windows close."""
    shard = Shard([ids[:-1] for _, ids in documents], statistics)
    left, shrunk, following = len(documents), len(documents), None
    for place in range(len(documents)):
        if not shard.unused[place]:
            continue
        seed, start = place, 0
        while seed is not None:
            # the seed, or its rest: the window it ends in takes its neighbours
            if shard.unused[seed]:
                shard.unused[seed], left = False, left - 1
            end = len(documents[seed][1])
            while start < end:
                closed, start = windows.put(documents[seed], start, end)
                if closed:
                    yield closed
            following = None
            if windows.used and left:
                if left * 3 < shrunk * 2:
                    shard.shrink()
                    shrunk = left
                for near in shard.neighbours(seed):
                    shard.unused[near], left = False, left - 1
                    closed, start = windows.put(documents[near], 0, len(documents[near][1]))
                    if closed:
                        yield closed
                        following = near if start < len(documents[near][1]) else None
                        break
            seed = following


def pack_neighbours(docs: DataFrame, vocabulary: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                    with_ids: bool = False, task_tokens: int = TASK_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Every text encoded, ``end_id`` behind it, in windows of ``size`` tokens (a power of two) that its
    lexical neighbours share.  Per piece: the id, ``start`` in the document, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset``; with ``with_ids`` also the ``ids``.

    Windows are full but for each task's last, whose tokens go to sequences of the powers of two they
    add up to; so nothing is padded.  Every document is in exactly one shard, shards hold whole
    documents, and a document longer than a window goes through several.  NULL and empty texts are the
    end id alone and go together.  Rows alike are packed each, beside each other; a NULL id is kept.
    Other columns are left out, so names cannot clash.  An empty table gives no rows.

    Large groups of like texts lie in as many tasks as their tokens ask for.  To the driver come one
    count per term of the vocabulary.  Ids are shuffled once, two bytes each; texts are not.
    """
    stored = pinned(encoded(docs, vocabulary, end_id, id_col, text_col), "encoded")
    statistics = Statistics({r["term"]: r["docs"] for r in _document_counts(stored).collect()})
    tasks = max(1, math.ceil(statistics.total / task_tokens))
    # places in the order are sampled: a digest stands for the ids
    order = [F.col(c).asc_nulls_first() for c in ("lead", "second", "id")] + [F.xxhash64("tokens")]
    dealt = _with_leads(stored, statistics).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()
    out = (f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
           + (", ids array<int>" if with_ids else ""))
    schema = _arrow(out)

    def described(pieces: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (doc_id, ids), start, length, sequence, offset in pieces:
            cut = ids[start:start + length].astype("<u4")
            row = (doc_id, start, length, zlib.crc32(cut.tobytes()), len(ids), sequence, offset)
            rows.append((*row, cut.tolist()) if with_ids else row)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(size, TaskContext.get().partitionId() << 33)
        held, ready = [], []

        def flushed(least: int):
            nonlocal ready
            if len(ready) >= least:
                yield described(ready)
                ready = []

        def shard():
            for pieces in _fill(windows, held, statistics):
                ready.extend(pieces)
                yield from flushed(1000)

        for batch in batches:
            for doc_id, tokens, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append((doc_id, _ids(tokens, width)))
                if len(held) == shard_docs:
                    yield from shard()
                    held = []
        yield from shard()
        ready.extend(windows.rest())
        yield from flushed(1)

    return dealt.select("id", "tokens", "width").mapInArrow(run, out)
