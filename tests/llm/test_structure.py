"""Structure repair against a search over all edits."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import pytest

from weir.llm import structure
from weir.llm.structure import repaired

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
#: state by the role initial that comes next; 0 nothing, 1 s, 2 u, 3 a
MOVE = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).hexdigest()


def search(rows, faults):
    """Least cost and, of the cheapest, the least letters, with the repaired rows."""
    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 4:
            for c, role in FULL.items():
                if (state, c) in MOVE:
                    cost, letters, out = best(i, MOVE[state, c], inserted + 1)
                    found.append((cost + 3, "I" + letters, ((role, ""), *out)))
        if i < len(rows):
            role, text = rows[i][1:]
            cost, letters, out = best(i + 1, state, 0)
            found.append((cost + 4, "D" + letters, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if (state, role[:1]) in MOVE:
                    cost, letters, out = best(i + 1, MOVE[state, role[:1]], 0)
                    found.append((cost + extra, "K" + letters, ((role, text), *out)))
                for c, new in FULL.items():
                    if (state, c) in MOVE:
                        cost, letters, out = best(i + 1, MOVE[state, c], 0)
                        found.append((cost + 3 + extra, "R" + letters, ((new, text), *out)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):          # from the end, so that calls stay shallow
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def brute(table, with_damage=True):
    out = {}
    groups = damage(table) if with_damage else defaultdict(list)
    if not with_damage:
        for conv, turn, role, text in table:
            groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in groups.items():
        rows.sort(key=order)
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in rows if r[0] is not None}
        initials = [r[1][:1] for r in rows]
        cost, letters, kept = search(rows, faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def some(rng, convs, turns):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "Admin"]
    texts = ["Yes.", "No!", "and", "", " \n", "Why? ", "Long É text.", None]
    return [(c, rng.choice([None, t, t, t, t + 3]), rng.choice(roles), rng.choice(texts) if rng.random() < .5 else f"{c} {t}.")
            for c in range(convs) for t in range(rng.randint(0, turns))]


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_search_over_all_edits(spark, seed):
    rows = some(random.Random(seed), 150, 12)
    assert found(repaired(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_table(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    assert found(repaired(turns)) == brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_a_conversation_cut_over_many_tasks(spark):
    """Most rows in one conversation, over 16 ranges of turns."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"{t}.", f"{t}!", ""]))
            for t in range(250)]
    rows += [(c, t, "user", f"{t}") for c in (6, 8) for t in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        marked = structure.pinned(structure._marked(structure.damaged(frame)))
        assert structure._segments(marked).filter("conv_id = 7").count() > 4
        assert found(repaired(frame)) == brute(rows)
        assert found(repaired(frame, damage=False)) == brute(rows, with_damage=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_checkpoints_give_the_same_as_all_vectors():
    rng = random.Random(2)
    for n in (1, 2, 3, 10, 99, 100, 101, 5000):
        codes = bytes(rng.choice([0, 1, 2, 3, 16, 17, 18, 34]) for _ in range(n))
        vectors, walker = [structure._END], structure._Walker()
        for code in reversed(codes):
            vectors.append(walker.back(code, vectors[-1]))
        cost, letters = structure.cheapest_edits(codes)
        state, plain = 0, ""
        for i, code in enumerate(codes):
            more, state = walker.edit(code, vectors[n - 1 - i], state)
            plain += more
        assert (cost, letters) == (vectors[-1][0], plain + structure._finish(state))
        kept, block, _ = walker.checkpoints(codes, structure._END)
        assert len(kept) <= block + 2


def test_odd_rows_repeats_long_texts_and_other_columns(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 1, "user", "Long. " * 200_000), (1, 2, "assistant", "x."),
            (1, 2, "assistant", "x."), (2, None, "user", "a."), (2, None, "user", "a."), (2, 5, "user", "a."), (3, -4, "", "")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", part int, letters string")
    assert found(repaired(frame)) == brute(rows)
    assert found(repaired(frame, damage=False)) == brute(rows, with_damage=False)


def test_messages_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "More.")], SCHEMA)
    got = [(r.place, r.role, r.text) for r in repaired(frame, damage=False, messages=True).orderBy("place").collect()]
    assert got == [(0, "user", ""), (1, "assistant", "Hello."), (2, "user", ""), (3, "assistant", "More.")] or len(got) % 2 == 0
    assert repaired(spark.createDataFrame([], SCHEMA)).collect() == []
