"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from weir.llm.common import per_text, pinned, shuffled
from weir.llm.workers import make_room
from weir.llm.components import components

BITS = 64
SEGMENTS = 3
CROWDED = 1_000                # distinct fingerprints of one segment value beyond which pairs are not compared
_STEP = 1 << 14                # shingles hashed at a time
SHORT_LIST = 500_000           # ids that may be sent to the texts instead of the texts to them


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of the word shingles of a text, repeats included, as a signed 64-bit number.

    Letters A-Z are lowered, words are what ASCII white space leaves, a bit is set if more than half
    of the shingles' XXH64 values (seed 42) have it.  Fewer words than ``shingle``: one shingle of
    all of them.  No word: zero.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total, ones = len(words) - shingle + 1, np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _STEP):
        upto = min(total, at + _STEP)
        found = [digest(line[a:b - 1], 42) for a, b in zip(starts[at:upto], ends[at + shingle - 1:upto + shingle - 1])]
        bits = np.unpackbits(np.array(found, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every document; row-local."""

    def make():
        make_room()
        return lambda text: (fingerprint(text, shingle),)

    return per_text(docs, [id_col], text_col, "fp long", make)


def _plan(max_bits: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(first bit, width, masks) per segment: of two fingerprints at most ``max_bits`` apart, one of
    the first segments differs in at most ``max_bits // segments`` bits or a later one in fewer."""
    radius, wide = divmod(max_bits, segments)
    edges = [BITS * i // segments for i in range(segments + 1)]
    plan = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        reach = radius if i <= wide else radius - 1
        if reach >= 0:
            plan.append((low, high - low, _ball(high - low, reach)))
    return plan


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _segment(fp: Column, low: int, width: int, number: int) -> Column:
    """The segment's value with its number above it."""
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(number << 40))


def _around(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: value.bitwiseXOR(m))


def near_links(fps: DataFrame, max_bits: int, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Links ``(a, b)`` that join exactly the fingerprints (distinct, column ``fp``) which steps of at
    most ``max_bits`` differing bits connect.

    Every fingerprint is entered in one table per segment; each looks up the Hamming ball round its
    own segment values and checks the whole distance of what it fetches.  A segment value shared by
    more than ``crowded`` fingerprints would ask for all pairs among them: those who look it up are
    linked through the fingerprints halfway between (the ball of half the distance round each), a
    number of rows in proportion to theirs.  No link is lost either way.
    """
    plan = _plan(max_bits, segments)
    keys = F.array(*[_segment(F.col("fp"), low, w, i) for i, (low, w, _) in enumerate(plan)])
    table = pinned(fps.select("fp", F.explode(keys).alias("key")), "segments")
    asked = [_around(_segment(F.col("fp"), low, w, i), masks) for i, (low, w, masks) in enumerate(plan)]
    probes = fps.select("fp", F.explode(F.flatten(F.array(*asked))).alias("key"))
    full = pinned(table.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "crowded")
    apart = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    pairs = probes.alias("x").join(shuffled(table.join(shuffled(full), "key", "left_anti")).alias("y"), "key").filter(
        (F.col("x.fp") < F.col("y.fp")) & (apart <= max_bits)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if full.isEmpty():
        return pairs
    asking = probes.join(shuffled(full), "key", "left_semi").select("fp").distinct()
    return pairs.union(_through_middles(asking, max_bits))


def _through_middles(fps: DataFrame, max_bits: int) -> DataFrame:
    """Of two fingerprints within ``max_bits``, one reaches a value halfway in the smaller half of the
    steps, the other in the larger half: link all that reach a value to one that is in the smaller."""
    half, rest = max_bits // 2, max_bits - max_bits // 2
    near, masks = len(_ball(BITS, half)), _ball(BITS, rest)
    reached = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("i", "m")).select(
        F.col("fp").bitwiseXOR(F.col("m")).alias("middle"), "fp", (F.col("i") < near).alias("near"))
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("middle"))
    return reached.select(F.col("fp").alias("a"), hub.alias("b")).filter("b <> a").distinct()


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text",
                    segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    that steps of at most ``max_bits`` differing bits lead to, its own included.

    Equal fingerprints are collapsed first, so copies are never paired.  NULL and empty texts have
    fingerprint zero and link like any other.  Rows with the same id are rows of one document.  A NULL
    id takes part and is nobody's component: NULL only where the whole group has no id.  Other columns
    are left out.  Fingerprints, links and each round of the components are written to the shared folder.
    """
    fps = pinned(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = pinned(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    found = pinned(components(near_links(distinct.select("fp"), max_bits, segments, crowded)), "components")
    labelled = distinct.join(shuffled(found), distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = pinned(labelled.join(shuffled(smallest), "component").select("fp", "component_id"), "classes")
    return fps.join(shuffled(classes), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text",
                  short_list: int = SHORT_LIST) -> DataFrame:
    """``docs`` without the documents that have a near-duplicate of smaller id, all columns kept.

    The document with the group's smallest id stays; rows without an id cannot be named and stay.  The
    ids that go are stored first: they are far fewer than those that stay, so a list of at most
    ``short_list`` may be sent to the texts, and texts are shuffled only beyond that.
    """
    marked = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    gone = pinned(marked.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct(), "gone")
    if gone.count() > short_list:
        gone = shuffled(gone)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
