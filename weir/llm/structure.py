"""Repair of conversation structure: the cheapest edits after which roles take turns.

Roles must read system (optional), then user and assistant in turn, ending with the assistant.  Per
conversation a row is one byte, its role's initial and its fault.  Backward over the rows runs a
vector of four numbers, the least cost to the end from each of the four states; only every
sqrt(n)-th is kept.  Walking forward, a block of rows is computed again from the checkpoint at its
end, and of the edits that keep the least cost (the tight ones) the letter first in ASCII is taken.

Rows are dealt by ranges of conversation and turn, so that a conversation of any size is cut into
segments.  Where it is cut, a segment first gives its costs between all pairs of states; chained
backward they are the vectors at the cuts, from which all segments walk at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weir.llm.common import pinned

# states: nothing yet, after system, after the user, after the assistant
START, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = "sua"
_KEEP = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
#: the state that a row or an inserted one of fitting role leads to, and that role
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
_REROLE, _DELETE, _INSERT, _CUT_SHORT = 3, 4, 3, 3
_FINE, _TRUNCATED, _GONE = range(3)
_END = (0, 6, 3, 0)             # from each state to the end without rows: assistants and users to insert
_BLANKS = " \t\n\x0b\x0c\r"
_STOPS = ".!?"


def _code(initial: Column, fault: Column) -> Column:
    """One byte, as two hex digits: the fault and the number of the initial (3: any other)."""
    at = F.instr(F.lit(_INITIALS), initial)
    return F.concat(fault.cast("string"), F.when((initial != "") & (at > 0), at - 1).otherwise(3).cast("string"))


class _Walker:
    """Steps between cost vectors, remembered: vectors less their first number are few."""

    def __init__(self):
        self.steps: dict = {}
        self.edits: dict = {}

    def back(self, code: int, after: tuple) -> tuple:
        """The vector before a row from the one after it."""
        fault, keep = code >> 4, _KEEP[code & 15]
        if fault == _GONE:
            base = [_DELETE + v for v in after]
        else:
            extra = _CUT_SHORT if fault == _TRUNCATED else 0
            base = [min(_DELETE + after[s], extra + _REROLE + after[_NEXT[s]], extra + after[keep[s]] if s in keep else inf)
                    for s in range(4)]
        user, assistant = min(base[USER], _INSERT + base[ASSISTANT]), min(base[ASSISTANT], _INSERT + base[USER])
        return min(base[START], _INSERT + user), min(base[SYSTEM], _INSERT + user), user, assistant

    def step(self, code: int, after: tuple) -> tuple[tuple, float]:
        """``back`` for vectors whose least number is 0, and what it adds."""
        key = (code, after)
        known = self.steps.get(key)
        if known is None:
            before = self.back(code, after)
            least = min(before)
            known = self.steps[key] = tuple(v - least for v in before), least
        return known

    def edit(self, code: int, after: tuple, state: int) -> tuple[str, int]:
        """The letters of a row from this state, insertions before it first, and the state behind it."""
        key = (code, after, state)
        known = self.edits.get(key)
        if known is None:
            before, letters, s = self.back(code, after), "", state
            fault, keep = code >> 4, _KEEP[code & 15]
            extra = _CUT_SHORT if fault == _TRUNCATED else 0
            while True:
                if _DELETE + after[s] == before[s]:
                    letters += "D"
                elif _INSERT + before[_NEXT[s]] == before[s]:
                    letters, s = letters + "I", _NEXT[s]
                    continue
                elif s in keep and extra + after[keep[s]] == before[s]:
                    letters, s = letters + "K", keep[s]
                else:
                    letters, s = letters + "R", _NEXT[s]
                break
            known = self.edits[key] = letters, s
        return known

    def checkpoints(self, codes: bytes, end: tuple) -> tuple[list[tuple], int, float]:
        """Vectors at the ends of blocks of sqrt(n) rows, the block's length and the cost they leave out."""
        block = isqrt(len(codes)) + 1
        vector, total = end, 0
        kept = []
        for first in range((len(codes) - 1) // block * block, -1, -block):
            kept.append(vector)
            for code in reversed(codes[first:first + block]):
                vector, more = self.step(code, vector)
                total += more
        kept.append(vector)
        return kept[::-1], block, total

    def costs(self, codes: bytes, end: tuple) -> tuple:
        """The vector before all rows."""
        kept, _, total = self.checkpoints(codes, end)
        return tuple(v + total for v in kept[0])

    def walk(self, codes: bytes, end: tuple, state: int) -> tuple[str, int]:
        """The tight edits from a state, and the state they lead to."""
        kept, block, _ = self.checkpoints(codes, end)
        letters = []
        for k, first in enumerate(range(0, len(codes), block)):
            part = codes[first:first + block]
            after = [kept[k + 1]]
            for code in reversed(part[1:]):
                after.append(self.step(code, after[-1])[0])
            for code in part:
                more, state = self.edit(code, after.pop(), state)
                letters.append(more)
        return "".join(letters), state


def _least(vector: tuple) -> tuple[tuple, float]:
    least = min(vector)
    return tuple(v - least for v in vector), least


def _finish(state: int) -> str:
    return "I" * (_END[state] // _INSERT)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the repair of a whole conversation of such bytes."""
    walker = _Walker()
    letters, state = walker.walk(codes, _END, START)
    return walker.costs(codes, _END)[START], letters + _finish(state)


def _illegal(codes: bytes) -> int:
    """Neighbours whose initials are not su, ua or au."""
    kinds = bytes(c & 15 for c in codes)
    legal = {b"\0\1", b"\1\2", b"\2\1"}
    return max(0, len(kinds) - 1) - sum(kinds[i:i + 2] in legal for i in range(len(kinds) - 1))


# ---- rows

def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` after damage: conv_id, turn, role, text, ``copies`` (2 for a repeated row,
    0 for a dropped one), by the crc32 of ``conv_id:turn`` modulo 20."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    kind, role, text = F.crc32(key) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, _STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text: how many there are (``times``), the digest of the
    text, and the fault of the first of them.  Texts stay behind."""
    rest = F.rtrim(F.col("text"), F.lit(_BLANKS))
    ended = F.instr(F.lit(_STOPS), F.right(rest, F.lit(1))) > 0
    single = rows.filter("copies > 0").select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies",
        (rest == "").alias("blank"), (~ended).alias("cut_short"))
    together = pinned(single.groupBy("conv_id", "turn", "role", "digest", "blank", "cut_short").agg(
        F.sum("copies").alias("times")), "turns")
    # the earliest turn of a role and text that stand in several turns; NULL turns come first
    first = together.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")]).agg(
        F.min("turn").alias("_first"), F.bool_or(F.col("turn").isNull()).alias("_none"), F.count("*").alias("_turns"),
    ).filter("_turns > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    seen = F.coalesce(F.when(F.col("_none"), F.col("turn").isNotNull()).otherwise(F.col("_first") < F.col("turn")), F.lit(False))
    return together.join(first, same, "left").select(
        *together.columns, (~F.col("blank") & seen).alias("again"))


def _segments(marked: DataFrame) -> DataFrame:
    """The bytes of a conversation's rows in order, one row per conversation and task."""
    order = ["conv_id", "turn", "role", "digest"]
    keys = [F.col(c).asc_nulls_first() for c in order]
    fault = F.when(F.col("blank") | F.col("again"), _GONE).when(F.col("cut_short"), _TRUNCATED).otherwise(_FINE)
    initial = F.substring("role", 1, 1)
    coded = marked.select(
        *order, F.unhex(_code(initial, fault)).alias("one"), F.unhex(_code(initial, F.lit(_GONE))).alias("more"), "times")
    dealt = coded.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", "one", "more", "times", F.spark_partition_id().alias("part"))
    kind = marked.schema["conv_id"].dataType.simpleString()

    schema = _arrow(f"conv_id {kind}, part int, codes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        done: list[tuple] = []
        for conv, members in groupby(rows, key=lambda r: r[0]):
            codes, part = bytearray(), 0
            for _, one, more, times, part in members:
                codes += one + more * (times - 1)
            done.append((conv, part, bytes(codes)))
            if len(done) == 1000 or len(codes) > 1 << 20:
                yield _batch(done, schema)
                done = []
        if done:
            yield _batch(done, schema)

    return pinned(dealt.mapInArrow(run, f"conv_id {kind}, part int, codes binary"), "segments")


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _per_row(df: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on every row as a dictionary, giving dictionaries of the schema's columns."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _Walker()
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in work(walker, row)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=described)

    described = _arrow(schema)
    return df.mapInArrow(run, schema)


def _audits(segments: DataFrame) -> DataFrame:
    """Per conversation and segment: ``letters``; on its first segment also ``cost`` and ``illegal``."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, part int, letters string, cost long, illegal long"
    several = pinned(segments.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select(
        F.col("conv_id").alias("_cut")), "cut")
    single = segments.join(several, F.col("conv_id").eqNullSafe(F.col("_cut")), "left_anti")
    cut = pinned(segments.join(several, F.col("conv_id").eqNullSafe(F.col("_cut")), "left_semi"), "cut_segments")

    def solve(walker: _Walker, row: dict):
        codes = row["codes"]
        letters, state = walker.walk(codes, _END, START)
        yield {"conv_id": row["conv_id"], "part": row["part"], "letters": letters + _finish(state),
               "cost": walker.costs(codes, _END)[START], "illegal": _illegal(codes)}

    def between(walker: _Walker, row: dict):
        """Costs from each state to each state: vectors back from an end that allows one state."""
        codes = row["codes"]
        ends = [tuple(0 if s == t else inf for s in range(4)) for t in range(4)]
        yield {"conv_id": row["conv_id"], "part": row["part"], "costs": [c for e in ends for c in walker.costs(codes, e)],
               "edge": [codes[0] & 15, codes[-1] & 15], "inner": _illegal(codes)}

    def chained(walker: _Walker, row: dict):
        """Vectors at the cuts, from the last segment backward."""
        vector, parts = _END, sorted(row["parts"], key=lambda p: p["part"])
        ends = {}
        for p in reversed(parts):
            ends[p["part"]] = vector
            vector = tuple(min(p["costs"][4 * t + s] + vector[t] for t in range(4)) for s in range(4))
        joints = sum(_illegal(bytes([a["edge"][1], b["edge"][0]])) for a, b in zip(parts, parts[1:]))
        for p in parts:
            first = p is parts[0]
            yield {"conv_id": row["conv_id"], "part": p["part"], "after": list(map(float, ends[p["part"]])),
                   "cost": int(vector[START]) if first else 0,
                   "illegal": sum(q["inner"] for q in parts) + joints if first else 0}

    def walked(walker: _Walker, row: dict):
        """The walk from every state a segment may begin in."""
        end, _ = _least(tuple(row["after"]))
        for state in range(4):
            letters, behind = walker.walk(row["codes"], end, state)
            yield {"conv_id": row["conv_id"], "part": row["part"], "begin": state, "letters": letters, "behind": behind,
                   "cost": row["cost"], "illegal": row["illegal"]}

    def chosen(walker: _Walker, row: dict):
        """The states at the cuts, from the first segment forward."""
        state, parts = START, sorted({m["part"] for m in row["moves"]})
        move = {(m["part"], m["begin"]): m["behind"] for m in row["moves"]}
        for p in parts:
            yield {"conv_id": row["conv_id"], "part": p, "begin": state, "finish": ""}
            state = move[p, state]
        yield {"conv_id": row["conv_id"], "part": parts[-1], "begin": -1, "finish": _finish(state)}

    costs = pinned(_per_row(cut, f"conv_id {kind}, part int, costs array<double>, edge array<int>, inner long", between), "costs")
    gathered = costs.groupBy("conv_id").agg(F.collect_list(F.struct("part", "costs", "edge", "inner")).alias("parts"))
    ends = _per_row(gathered, f"conv_id {kind}, part int, after array<double>, cost long, illegal long", chained)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    named = [F.col("conv_id").alias("_conv"), F.col("part").alias("_part")]
    walks = pinned(_per_row(
        cut.join(ends.select(*named, "after", "cost", "illegal"), same).drop("_conv", "_part"),
        f"conv_id {kind}, part int, begin int, letters string, behind int, cost long, illegal long", walked), "walks")
    moves = walks.groupBy("conv_id").agg(F.collect_list(F.struct("part", "begin", "behind")).alias("moves"))
    begins = pinned(_per_row(moves, f"conv_id {kind}, part int, begin int, finish string", chosen), "begins")
    taken = walks.join(begins.filter("begin >= 0").select(*named, F.col("begin").alias("_begin")),
                       same & (F.col("begin") == F.col("_begin"))).select("conv_id", "part", "letters", "cost", "illegal")
    # what is inserted at the very end comes as a last segment
    ending = begins.filter("begin < 0 AND finish <> ''").select(
        "conv_id", (F.col("part") + 1).alias("part"), F.col("finish").alias("letters"),
        F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("illegal"))
    return pinned(_per_row(single, out, solve).unionByName(taken).unionByName(ending), "audits")


def _counts(turns: DataFrame, marked: DataFrame) -> DataFrame:
    """Faults and gaps per conversation, for all conversations of ``turns``."""
    blank, again = F.col("blank"), F.col("again")
    truncated = ~blank & ~again & F.col("cut_short")
    per_turn = marked.groupBy("conv_id", "turn").agg(
        F.sum(F.when(blank, F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(~blank, F.col("times") - F.when(again, 0).otherwise(1)).otherwise(0)).alias("duplicate"),
        F.sum(truncated.cast("long")).alias("truncated"))
    none = turns.select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast(marked.schema["turn"].dataType).alias("turn"),
        *[F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    return per_turn.unionByName(none).groupBy("conv_id").agg(
        F.coalesce(F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


class _Repaired:
    """The rows of one conversation after its edits, one after the other."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            yield _ROLE[self.state], ""
            self.state, self.at = _NEXT[self.state], self.at + 1

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        for _ in range(copies):
            yield from self._inserted()
            letter, self.at = self.letters[self.at], self.at + 1
            if letter == "K":
                yield role, text
                self.state = _KEEP[_INITIALS.index(role[0])][self.state]
            elif letter == "R":
                yield _ROLE[self.state], text
                self.state = _NEXT[self.state]

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


_HEAD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(turns: DataFrame, damage: bool = True, messages: bool = False) -> DataFrame:
    """Conversations (conv_id, turn, role, text) after damage and repair: per conversation the counts of
    ``gaps``, ``blank``, ``duplicate``, ``truncated`` and ``illegal`` rows, the ``cost`` and letters
    (``audit``) of the cheapest edits, and ``repaired_sha256`` of the repaired rows.  With ``messages``
    the repaired rows instead: conv_id, ``place``, role, text.  Without ``damage`` the rows are as given.

    Rows stand by turn, NULL first, those of one turn by role and the digest of their text.  NULL role
    and text are one space; NULL conv_id is a conversation of its own.  A role starting with another
    letter than s, u or a cannot be kept, nor can an empty one.  Rows of one turn, role and text are
    duplicates of each other.  Other columns are left out.  An empty table gives no rows; a conversation
    all of whose rows are dropped gives zeros.

    Rows without texts are dealt by ranges of conversation and turn, so a long conversation lies in
    many tasks.  Texts are dealt by conversation and stream through the hash in order, as sha256 must:
    a task holds its batch of rows and the letters of one conversation, which are part of its result.
    """
    columns = turns.select("conv_id", "turn", "role", "text")
    rows = damaged(columns) if damage else columns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))
    marked = pinned(_marked(rows), "marked")
    audits = _audits(_segments(marked))
    heads = _counts(columns, marked).withColumns({c: F.lit(0).cast("long") for c in ("illegal", "cost")})
    none = [F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")]
    turn = F.lit(None).cast(turns.schema["turn"].dataType).alias("turn")
    parts = heads.select("conv_id", F.lit(-1).alias("part"), turn, *none, F.lit(0).alias("copies"), *_HEAD, F.lit("").alias("letters"))
    parts = parts.unionByName(audits.select(
        "conv_id", "part", turn, *none, F.lit(0).alias("copies"), *[
            F.col(c) if c in audits.columns else F.lit(0).cast("long").alias(c) for c in _HEAD], "letters"))
    texts = rows.filter("copies > 0").select(
        "conv_id", F.lit(None).cast("int").alias("part"), "turn", "role", F.sha2("text", 256).alias("digest"), "text",
        F.col("copies").cast("int").alias("copies"), *[F.lit(None).cast("long").alias(c) for c in _HEAD], F.lit("").alias("letters"))
    every = parts.unionByName(texts).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("part").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "digest")
    kind = turns.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, place long, role string, text string" if messages else (
        f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _HEAD) + ", audit string, repaired_sha256 string")
    needed = ["conv_id", "part", "role", "text", "copies", *_HEAD, "letters"]
    return every.select(*needed).mapInArrow(_hashed(out, messages), out)


def _hashed(out: str, messages: bool):
    described = _arrow(out)

    def conversations(batches) -> Iterator[tuple]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256)
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)))
        for conv, members in groupby(rows, key=lambda r: r[0]):
            totals, letters, work, place = [0] * len(_HEAD), [], None, 0
            said = hashlib.sha256()

            def told(lines):
                nonlocal place
                for role, text in lines:
                    if messages:
                        yield conv, place, role, text
                    else:
                        said.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
                    place += 1

            for _, part, role, text, copies, *rest in members:
                if part is not None:
                    totals = [a + b for a, b in zip(totals, rest)]
                    letters.append(rest[-1])
                    continue
                if work is None:
                    work = _Repaired("".join(letters))
                yield from told(work.row(role, text, copies))
            work = work or _Repaired("".join(letters))
            yield from told(work.rest())
            if not messages:
                yield conv, *totals, work.letters, said.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in conversations(batches):
            held.append(row)
            size += len(row[-2] if not messages else row[-1])
            if len(held) == 1000 or size > 1 << 22:
                yield _batch(held, described)
                held, size = [], 0
        if held:
            yield _batch(held, described)

    return run
