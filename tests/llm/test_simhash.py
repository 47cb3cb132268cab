import random

import pytest
import xxhash

from weir.llm.components import components
from weir.llm.simhash import fingerprint, first_of_each, near_duplicates, near_links

DOCS = "doc_id long, text string, source string, fp long, key long"


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    found = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def brute(docs, k=4, bits=4):
    fps = [brute_fingerprint(t, k) for _, t in docs]
    label = brute_classes(range(len(docs)), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= bits)
    best = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            best[label[i]] = min(doc, best.get(label[i], doc))
    return sorted(((d, f"{f:016x}", best.get(label[i])) for i, ((d, _), f) in enumerate(zip(docs, fps))), key=repr)


def table(spark, docs):
    return spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs], DOCS)


@pytest.mark.parametrize("text", ["", " \n", "one", "One tWo\tthree", "É ÀB c d e É ÀB c d e", "a b " * 40_000, "a\x85b c\xa0d e"])
def test_fingerprint_is_the_plain_one(text):
    assert fingerprint(text, 4) & (1 << 64) - 1 == brute_fingerprint(text)


def sample():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 60, 400]))]
        for _ in range(rng.choice([1, 1, 3, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), " ".join(text)))
    return docs + [(900, None), (901, ""), (901, ""), (None, docs[0][1]), (None, "quite alone here now"), (5, docs[5][1])]


@pytest.mark.parametrize("segments, crowded", [(3, 1000), (2, 1000), (4, 1000), (3, 1), (5, 0)])
def test_near_duplicates_match_brute_force(spark, segments, crowded):
    docs = sample()
    got = near_duplicates(table(spark, docs), 4, 4, segments=segments, crowded=crowded).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs)


@pytest.mark.parametrize("bits", [0, 1, 3, 4])
def test_links_of_random_numbers_connect_all_near_ones(spark, bits):
    rng, values = random.Random(bits), set()
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(4):
            values.add(v)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                v ^= 1 << b
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = brute_classes(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= bits)
    for crowded in (1000, 0):
        links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, crowded=crowded)
        got = {v: v for v in signed} | {r.node: r.component for r in components(links).collect()}
        assert got == want


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    links += [(7, 7), (None, 3), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 202: 200}


def test_one_of_each_group_stays(spark):
    docs = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words are in this one"), (2, "other words are in this one"), (None, "a b c d e f")]
    left = first_of_each(table(spark, docs), 4, 4)
    assert left.columns == ["doc_id", "text", "source", "fp", "key"]
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 2]        # a row without an id cannot be named


def test_empty_table(spark):
    assert near_duplicates(table(spark, []), 4, 4).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_that_grows_is_broadcast(spark):
    from weir.llm import components as c
    from weir.llm.common import pinned

    docs = table(spark, [(i, f"a{i % 10} b c d{i % 7} e") for i in range(200)])
    fps = pinned(spark.range(300).selectExpr("id AS fp"), "few")
    edges = pinned(spark.range(300).selectExpr("id + 1 AS a", "id AS b"), "links")
    for df in (near_links(fps, 4), near_links(fps, 4, crowded=5), near_duplicates(docs, 4, 4), c._large_star(edges),
               c._small_star(edges), first_of_each(docs, 4, 4, short_list=0)):
        assert "Join" in plan(df) and "Broadcast" not in plan(df)


def test_long_and_short_lists_leave_the_same_documents(spark):
    docs = table(spark, sample())
    kept = [sorted(r.doc_id or -1 for r in first_of_each(docs, 4, 4, short_list=n).collect()) for n in (0, 1_000)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
