"""Conversations by quotation: quoted passages are linked to the messages they come from.

DataFrame work throughout.  Messages are split into lines with their quote level and into passages,
the sentences of neighbouring lines of one level; quoted passages meet the conversation's own ones
on hashes of their normalised words.  Whom a message answers gives a tree, whose order is read off
its tour by pointer doubling, so one conversation may hold any share of all messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weir.llm.common import pinned

MARKS = r"^[ \t]*(?:>[ \t]?)+"            # the quote marks at the beginning of a line
ANNOUNCES = r"^(?:On|Am|Le|El)\b.*(?:wrote|schrieb|écrit|escribió)[^:]*:[ \t]*$"
MIN_WORDS = 3                             # shorter passages are common: the latest message tells where they come from
MIN_LETTERS = 16                          # unless they are long, as where words are not parted
ENDS = r"(?<=[.!?])\s+|(?<=[。！？｡])\s*"   # between sentences
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
_NONE, _LAST = -(1 << 63), (1 << 61)      # stand for a missing conversation and a missing turn
_KEYS = ["c", "t"]


def _lines(text: Column) -> Column:
    """(level, body) of each line."""
    def line(raw: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(raw, f"({MARKS})", 1), "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(raw, MARKS, "").alias("body"))

    return F.transform(F.split(text, r"\r\n|\r|\n"), line)


def parsed(messages: DataFrame) -> DataFrame:
    """``messages(c, t, body)`` with ``own``, the text without quotations and the lines that announce
    them, and ``passages``, an array of (level, h1, h2, size, short) of each passage that has a letter or
    digit; ``short`` ones have less than ``MIN_WORDS`` words and ``MIN_LETTERS`` letters.

    Row-local.  Each array is laid down by ``explode`` of one element, so it is computed once and not
    again for every line that looks at its neighbour.
    """
    lines = messages.select("*", F.explode(F.array(_lines(F.col("body")))).alias("lines"))
    after = lambda i: F.try_element_at("lines", i + 2)["level"]
    told = lines.select("*", F.explode(F.array(F.transform("lines", lambda x, i: F.struct(
        F.when((x["level"] == 0) & x["body"].rlike(ANNOUNCES) & (F.coalesce(after(i), F.lit(0)) > 0), -1).otherwise(
            x["level"]).alias("level"), x["body"].alias("body"))))).alias("told")).drop("lines")
    before = lambda i: F.try_element_at("told", F.when(i > 0, i).otherwise(F.size("told") + 1))["level"]
    starts = F.filter(F.transform("told", lambda x, i: F.when(
        F.coalesce(before(i) != x["level"], F.lit(True)) | (F.trim(x["body"]) == ""), i)), lambda i: i.isNotNull())
    cut = told.select("*", F.explode(F.array(starts)).alias("starts"))
    run = lambda i, j: F.slice("told", i + 1, F.coalesce(F.try_element_at("starts", j + 2), F.size("told")) - i)
    runs = F.transform("starts", lambda i, j: F.struct(
        F.try_element_at("told", i + 1)["level"].alias("level"),
        F.array_join(F.transform(run(i, j), lambda x: x["body"]), " ").alias("text")))
    sentences = F.flatten(F.transform(runs, lambda r: F.transform(
        F.split(r["text"], ENDS), lambda s: F.struct(r["level"].alias("level"), F.regexp_replace(F.trim(
            F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")), f"(?<={_CJK}) (?={_CJK})", "").alias("text")))))
    worded = F.filter(sentences, lambda s: (s["level"] >= 0) & (s["text"] != ""))
    hashed = F.transform(worded, lambda s: F.struct(
        s["level"].alias("level"), F.xxhash64(s["text"]).alias("h1"), F.hash(s["text"]).alias("h2"), F.length(s["text"]).alias("size"),
        ((F.size(F.split(s["text"], " ")) < MIN_WORDS) & (F.length(s["text"]) < MIN_LETTERS)).alias("short")))
    own = F.regexp_replace(F.array_join(F.transform(
        F.filter("told", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")
    quoting = F.exists("told", lambda x: x["level"] != 0)
    return cut.select(
        *messages.columns, F.when(quoting, own).otherwise(F.col("body")).alias("own"), hashed.alias("passages"))


def reply_links(rows: DataFrame) -> DataFrame:
    """``(c, t, answered)`` from ``rows(c, t, passages)``: the message that a quotation comes from, the
    first of the conversation to hold the passage as its own words, or the latest before the quotation
    if the passage is short.  Of several the one quoted at the lowest level counts, then the one with
    more passages that are not short, the longest passage, more passages, then the later one.

    A passage has one origin per conversation, an aggregate with map-side combine, or per quotation,
    off a sort by ranges, so passages that many messages hold are never paired.
    """
    units = rows.select("c", "t", F.explode("passages").alias("p")).select("c", "t", "p.*")
    quoted = pinned(units.filter("level > 0").distinct(), "quoted")
    own = units.filter("level = 0")
    origins = own.filter("NOT short").groupBy("c", "h1", "h2").agg(F.min("t").alias("answered"))
    columns = ["c", "t", "level", "size", "short", "answered"]
    met = quoted.filter("NOT short").join(origins, ["c", "h1", "h2"]).filter("answered < t").select(*columns)
    short = quoted.filter("short")
    if not short.isEmpty():
        met = met.union(_latest(short, own.filter("short")).select(*columns))
    counts = met.groupBy("c", "t", "level", "answered").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("short"), 1)).alias("long"), F.max("size").alias("size"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "long", "size", "n", "answered"))
    return counts.withColumn("size", F.when(F.col("long") == 0, F.col("size")).otherwise(0)).groupBy("c", "t").agg(
        best.alias("best")).select("c", "t", F.col("best.answered").alias("answered"))


def _latest(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """``quoted`` passages with ``answered``, the latest turn before theirs that holds the passage among
    ``own``.  Sorted by ranges like ``_ranked``; each range hands on its last own passage."""
    keys = ["c", "h1", "h2", "t"]
    rows = quoted.withColumn("said", F.lit(0)).unionByName(
        own.select(*keys).distinct().withColumn("said", F.lit(1)), allowMissingColumns=True)
    dealt = pinned(rows.repartitionByRange(*keys, "said").withColumn("part", F.spark_partition_id()), "short")
    said, before = F.when(F.col("said") == 1, F.struct(*keys)), (Window.unboundedPreceding, -1)
    carried = dealt.groupBy("part").agg(F.max(said).alias("end")).select(
        "part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(*before)).alias("carried"))
    within = Window.partitionBy("part").orderBy(*keys, "said").rowsBetween(*before)
    return dealt.select("*", F.last(said, ignorenulls=True).over(within).alias("near")).join(carried, "part").withColumn(
        "origin", F.coalesce("near", "carried")).filter("said = 0 AND origin.c = c AND origin.h1 = h1 AND origin.h2 = h2").withColumn(
        "answered", F.col("origin.t"))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (distinct in ``order``) with ``rank``, their place in the whole table, and ``before``, the
    ``order`` columns of the row before.  Sorted by ranges, so no key has to fit a task; ranges are
    stored, and one row a range is carried over to the next one."""
    dealt = pinned(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("end"))
    over = Window.orderBy("part")
    carried = ends.select("part", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
                          F.lag("end").over(over).alias("carried"))
    within = Window.partitionBy("part").orderBy(*order)
    return dealt.select("*", F.row_number().over(within).alias("n"), F.lag(F.struct(*order)).over(within).alias("near")).join(
        carried, "part").select(*rows.columns, (F.col("base") + F.col("n") - 1).alias("rank"), F.coalesce("near", "carried").alias("before"))


def _tour(tree: DataFrame) -> DataFrame:
    """``(c, t, ahead)`` of ``tree(c, t, parent)``: the more steps of the tour lie ahead, the earlier a
    message is.  The tour goes down to a message, through its answers by turn, and up again."""
    first = tree.filter("parent IS NOT NULL").groupBy("c", "parent").agg(F.min("t").alias("child"))
    ordered = _ranked(tree.filter("parent IS NOT NULL"), ["c", "parent", "t"]).filter(
        (F.col("before.c") == F.col("c")) & (F.col("before.parent") == F.col("parent")))
    siblings = ordered.select("c", F.col("before.t").alias("t"), F.col("t").alias("sibling"))
    down, up = (lambda t: F.col(t) * 2), (lambda t: F.col(t) * 2 + 1)
    known = pinned(tree.join(first.withColumnRenamed("parent", "t"), _KEYS, "left").join(siblings, _KEYS, "left"), "tree")
    steps = known.select("c", down("t").alias("e"), F.coalesce(down("child"), up("t")).alias("to")).union(
        known.select("c", up("t"), F.coalesce(down("sibling"), up("parent")))).withColumn(
        "ahead", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long"))
    steps = pinned(steps, "tour")
    while not steps.filter("to IS NOT NULL").isEmpty():
        far = steps.select("c", F.col("e").alias("to"), F.col("to").alias("next"), F.col("ahead").alias("more"))
        steps = pinned(steps.join(far, ["c", "to"], "left").select(
            "c", "e", F.col("next").alias("to"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")), "tour")
    return steps.filter("pmod(e, 2) = 0").select("c", F.floor(F.col("e") / 2).cast("long").alias("t"), "ahead")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Every message without its quotations, with the turn it answers and its place in reply order:
    ``conv, position, turn, role, text, reply_to``.

    A message that quotes answers the message its quotation comes from, another one the message of the
    turn before.  ``position`` counts from 0: a message stands behind the one it answers and the answers
    of the same message that came earlier, with all that followed those.  Without branches that is the
    order of turns.  Rows of one turn are one message and share its place; a NULL turn is the last,
    a NULL conversation is one of its own; a NULL text is kept and quotes nothing.  Other columns are
    left out.  Turns must be whole numbers of less than 2**60 either way.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
        F.coalesce(F.col(conv_col).cast("long"), F.lit(_NONE)).alias("c"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(_LAST)).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    told = pinned(parsed(rows), "parsed")
    links = pinned(reply_links(told), "links")
    turns = _ranked(told.select(*_KEYS).distinct(), _KEYS).select(
        *_KEYS, F.when(F.col("before.c") == F.col("c"), F.col("before.t")).alias("previous"))
    tree = pinned(turns.join(links, _KEYS, "left").select(*_KEYS, "previous", F.coalesce("answered", "previous").alias("parent")), "turns")
    # only conversations with a branch need their tour
    branched = pinned(tree.filter("parent <> previous").select("c").distinct(), "branched")
    keyed = tree.withColumn("ahead", F.lit(None).cast("long"))
    if not branched.isEmpty():
        tour = pinned(_tour(tree.join(branched, "c", "left_semi").select(*_KEYS, "parent")), "order")
        keyed = tree.join(tour, _KEYS, "left")
    ranks = _ranked(keyed.select("c", F.coalesce(-F.col("ahead"), F.col("t")).alias("place"), "t", "parent"), ["c", "place"])
    ranks = pinned(ranks.select(*_KEYS, "parent", "rank"), "ranks")
    starts = pinned(ranks.groupBy("c").agg(F.min("rank").alias("start")), "starts")
    placed = pinned(ranks.join(starts, "c").select(*_KEYS, "parent", (F.col("rank") - F.col("start")).alias("position")), "places")
    return told.join(placed, _KEYS).select(
        F.col("conv").alias(conv_col), F.col("position").cast("long"), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
        F.when(F.col("text").isNotNull(), F.col("own")).alias(text_col), F.col("parent").alias("reply_to"))
