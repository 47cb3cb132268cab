import hashlib
import random

import pytest

from weir.llm.suffixes import BLOCK, removal_report, without_repeats


def brute(docs, length):
    """(id, text) rows: which bytes go, by a table of all strings."""
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            s, at = data[i:i + length], (order(d), i)
            first[s] = min(at, first.get(s, at))
    out = []
    for d, t in docs:
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < (order(d), i):
                gone[i:i + length] = [True] * length
        left = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest(), left))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "añd", "thing", "ble", "漢字", "x"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [sentence(60) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [sentence(rng.randint(0, 50))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a:a + rng.randint(60, 300)], sentence(rng.randint(0, 20))]
        docs.append((i * 3 % 41, rng.choice(["", " "]).join(parts)))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, docs[1][1][5:]), (103, "ab" * 400), (104, "a" * 500), (105, "a" * 500)]
    return docs + [(106, None), (107, ""), (None, docs[2][1]), (None, "z" * 150), (5, docs[5][1]), (5, "other " + docs[6][1]), (3, docs[1][1])]


def table(spark, docs):
    rows = [(d, t, 1, "p") for d, t in docs]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, size int, doc string").repartition(5)


@pytest.mark.parametrize("seed, length, block", [(1, 100, BLOCK), (2, 100, 4096), (3, 40, BLOCK), (4, 20, BLOCK), (5, 100, 700)])
def test_report_matches_brute_force(spark, seed, length, block):
    docs = corpus(seed)
    got = [tuple(r) for r in removal_report(table(spark, docs), length, block_size=block).collect()]
    assert sorted(got, key=repr) == sorted([r[:5] for r in brute(docs, length)], key=repr)


def test_buckets_read_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        docs = corpus(7)
        got = [tuple(r) for r in removal_report(table(spark, docs), 100).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted([r[:5] for r in brute(docs, 100)], key=repr)


def test_texts_are_cut_and_columns_stay(spark):
    docs = corpus(8)
    left = without_repeats(table(spark, docs), 100)
    assert left.columns == ["doc_id", "text", "size", "doc"]
    want = [(d, r[5].decode("utf-8", "ignore") if r[2] else t, 1, "p") for (d, t), r in zip(docs, brute(docs, 100))]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert removal_report(table(spark, []), 100).collect() == []
