"""The manifest against hash trees built row by row."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from weir.llm.merkle import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """The root and, per leaf, its siblings before and behind it on every level."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for leaf, k in enumerate(at):
            run = level[k // 16 * 16:k // 16 * 16 + 16]
            paths[leaf].append((run[:k % 16], run[k % 16 + 1:]))
            at[leaf] = k // 16
        level = [digest(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        small = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        head = [field(v) for v in (doc_id, source, lang, n)]
        groups[source].append((doc_id is not None, doc_id or 0, digest(*head, field(text)), digest(*head, field(small))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([r[2] for r in sorted(groups[s])]) for s in names}
    root, tops = tree([built[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (known, doc_id, leaf, small), path in zip(sorted(groups[s]), built[s][1]):
            folded = small
            for before, behind in path + top:
                folded = digest(*before, folded, *behind)
            proof = digest(*[d for before, behind in path + top for d in before + behind])
            out.append((doc_id if known else None, leaf, built[s][0], root, proof, folded, folded == root))
    return out


def same(got, rows):
    order = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, brute(rows)))


def some(n, sources, start=0):
    return [(start + i, f"Text {i} É\n", "en" if i % 3 else None, sources[i % len(sources)], i) for i in range(n)]


@pytest.mark.parametrize("rows", [
    some(700, ["a", "a", "b"]),                                       # three levels, and two
    some(1, ["a"]), some(17, ["a"]), some(16, ["a"]),                 # one source; a run of one
    some(40, [f"s{i}" for i in range(40)]),                           # sources of one leaf, two levels above
    some(60, [None, "", "é", "z", "Z", "a"]),
], ids=["hot", "single", "seventeen", "sixteen", "sources", "names"])
def test_equals_trees_built_by_hand(spark, rows):
    assert same(manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS, share=50), rows)


def test_nulls_ties_repeats_long_texts_and_other_columns(spark):
    rows = some(30, ["a", "b"]) + [(5, "OTHER", "en", "b", 1)] * 3 + [(None, None, None, None, None)] * 2 + [
        (None, "", "", "", 0), (77, None, None, "a", None), (90, "Long É " * 100_000, "fr", "a", 1)]
    frame = spark.createDataFrame([(*r, 1, b"x", "p") for r in rows], SCHEMA + ", idx int, digest binary, tree string")
    assert same(manifest(frame, COLUMNS), rows)


def test_tampering_shows(spark):
    rows = some(50, ["a"])
    got = {r.doc_id: r for r in manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS).collect()}
    for doc_id in got:
        assert got[doc_id].verified == (zlib.crc32(str(doc_id).encode()) % 5 != 0)


def test_empty_table_and_setting_kept(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    assert manifest(spark.createDataFrame([], SCHEMA), COLUMNS).collect() == []
    manifest(spark.createDataFrame(some(20, ["a"]), SCHEMA), COLUMNS).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == before
