import hashlib
import random

import numpy as np
import pytest

from weir.llm import order_minhash as omh


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, docs, parts=4):
    return spark.createDataFrame([(d, t, 1, "f") for d, t in docs], "doc_id long, text string, n_chars int, place string").repartition(parts)


def brute(docs):
    """Edited texts and fingerprints, one document after the other."""
    key = lambda d: (d is None, d or 0)
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (key(r[0]), r[1]))
    heads = {}
    for d, t in docs:
        heads.setdefault(d, t)
    ids = list(heads)
    out = []
    for d, t in docs:
        after = heads[ids[(ids.index(d) + 1) % len(ids)]]
        half = len(t) // 2
        new = t[:len(t) - half] + after[:half]
        a, b, c = (omh.fingerprint(x) for x in (t, new, after))
        out.append((d, len(t), sha(new), omh.written(a), omh.written(b), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=repr)


def plain_fingerprint(text, k, size):
    """The same by sets and sorting."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    kmers, seen, named = omh._kmers(points, k), {}, []
    for i, x in enumerate(kmers.tolist()):
        n = seen.get(text[i:i + k], 0)
        seen[text[i:i + k]] = n + 1
        named.append(int(omh._mixed(np.array([x], np.uint64) + np.array([n], np.uint64) * np.uint64(0x94D049BB133111EB))[0]))
    out = []
    for m in omh._MULTIPLIERS.tolist():
        best = sorted(range(len(named)), key=lambda i: ((named[i] >> 32) * m & 0xFFFFFFFF, i))[:size]
        h = np.array([size], np.uint64)
        for i in sorted(best):
            h = omh._mixed(h * np.uint64(0xBF58476D1CE4E5B9) + np.array([named[i]], np.uint64))
        out.append(int(h[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("size", [1, 2, 3])
def test_fingerprint_is_the_plain_one(size):
    rng = random.Random(size)
    for n in (1, 3, 9, 10, 300, 9000):
        text = "".join(rng.choice("abé漢 ") for _ in range(n))
        assert omh.fingerprint(text, 5, size).tolist() == plain_fingerprint(text, 5, size)


def test_order_matters_and_edits_show():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b = words(200), words(200)
    like = lambda x, y: omh.likeness(omh.fingerprint(x), omh.fingerprint(y))
    assert like(a, a) == 1 and like(a, b) < 0.1
    assert like(a + b, b + a) < like(a + b, a + b[:-20])
    assert 0.5 < like(a, a.replace(a[600:606], "zzzzzz")) < 1
    assert omh.fingerprint("").tolist() == [0] * 64


def test_report_matches_brute_force(spark):
    rng = random.Random(2)
    docs = [(rng.randrange(10**6), "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 1, 7, 200, 900])))) for _ in range(80)]
    docs += [(5, "twice"), (5, "twice"), (5, "other"), (6, None), (None, "no id"), (None, "none either"), (7, docs[0][1]), (8, docs[0][1])]
    got = omh.edit_report(table(spark, docs))
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)


def test_many_rows_of_one_and_of_no_id(spark):
    """A third of the rows has no id, a third one id; both are spread over ranges."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 5, 90])))
    docs = [(None, text()) for _ in range(100)] + [(50, text()) for _ in range(100)] + [(i, text()) for i in range(100) if i != 50]
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted((tuple(r)[:7] for r in omh.edit_report(table(spark, docs)).collect()), key=repr) == brute(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_small_tables(spark):
    for docs in ([], [(1, "alone here")], [(1, "a b"), (1, "a b")], [(None, None)]):
        assert sorted((tuple(r) for r in omh.edit_report(table(spark, docs)).collect()), key=repr) == brute(docs)


def test_fingerprints_of_rows(spark):
    got = omh.fingerprints(table(spark, [(1, "some text"), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_chars, r.fingerprint) for r in got) == [
        (1, 9, omh.written(omh.fingerprint("some text"))), (2, 0, "0" * 256)]
