import math
import random

import numpy as np
import pytest

from weir.llm.maxscore import Postings, nearest, top_k


def brute(rows, every, k, scale):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in fine:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, a in queries.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, rank string, v int").repartition(3)


@pytest.mark.parametrize("spread", [1.0, 0.01, 3.0])
def test_search_is_exact(spread):
    rng = np.random.default_rng(int(spread * 10))
    centres = rng.normal(size=(7, 16))
    vectors = np.floor((centres[rng.integers(0, 7, 900)] + spread * rng.normal(size=(900, 16))) * 20)
    ids = rng.permutation(900)
    shard = Postings(ids, vectors)
    for q in range(0, 900, 30):
        scores = vectors @ vectors[q]
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:5]
        assert shard.search(vectors[q], int(ids[q]), 5) == [(-s, i) for s, i in want]


def test_all_products_negative_or_zero():
    shard = Postings(np.arange(4), np.array([[-1.0, 0], [-2, 0], [0, 0], [0, -1]]))
    assert shard.search(np.array([1.0, 0]), 9, 5) == [(0, 2), (0, 3), (-1, 0), (-2, 1)]
    assert shard.search(np.array([0.0, 0]), 9, 2) == [(0, 0), (0, 1)]


def test_nearest_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() for _ in range(8)]) for i in range(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (50, rows[50][1]), (7, rows[7][1])]
    rows += [(450, None), (500, [None] * 8), (550, [math.nan] * 8), (600, [math.inf] * 8), (650, []), (700, [0.5]), (None, [1.0] * 8), (-50, [0.25] * 8)]
    got = nearest(table(spark, rows), 50, 5, 256)
    assert sorted(map(tuple, got.collect())) == brute(rows, 50, 5, 256)


def test_shards_and_blocks_give_the_same(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    got = top_k(frame, frame.filter("id % 10 = 0"), 3, rows=17, per_task=4).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 3, 1)


def test_fewer_rows_than_asked_for_and_none(spark):
    assert sorted(map(tuple, nearest(table(spark, [(0, [1.0]), (1, [2.0])]), 50, 5, 256).collect())) == [(0, 1, 1, 512 * 256)]
    assert nearest(table(spark, []), 50, 5, 256).collect() == []


def test_products_that_would_not_be_exact_are_an_error(spark):
    fine = [(0, [2.0 ** 17] * 4), (1, [-(2.0 ** 17)] * 4)]
    assert sorted(map(tuple, nearest(table(spark, fine), 50, 5, 256).collect())) == brute(fine, 50, 5, 256)
    for large in (2.0 ** 20, 1e300):
        with pytest.raises(Exception, match="id 3 is too long"):
            nearest(table(spark, [*fine, (3, [0.0, large])]), 50, 5, 256).collect()
