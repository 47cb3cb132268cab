import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weir.functions.fixed_values import EVENT_CLASSES, NOTICE_KEYS
from weir.functions.fixed_values import MINUTES, SIGNED_DEGREES
from weir.functions.numbers import finite, first_number
from weir.operators import documents, notices
from weir.operators.lexicon import EVENT_LEXICON, lexicon_classify, lexicon_sentiment
from weir.operators import vectors
from weir.operators.vectors import cosine_topk, retrieval_context

NOTICE = "TITLE: N\nOBS_TIME: 1080.00 [sec]   (=18.0 [min])\n\n   \nWHEN: 21:12:43 UT\nCOMMENTS: one\nCOMMENTS: two: b\nMERIT: 69.00"


@pytest.fixture
def notice(spark):
    return spark.createDataFrame([(1, NOTICE)], "ts INT, msg STRING")


def test_lines_split_at_the_first_colon(notice):
    got = {(r.key, r.value) for r in notices.key_values(notice, "msg").collect()}
    assert ("WHEN", "21:12:43 UT") in got and ("COMMENTS", "two: b") in got and len(got) == 6


def test_pivot_takes_the_largest_and_ignores_unknown_keys(notice):
    r = notices.typed_notices(notices.pivot_notices(notice, "msg", ["ts"])).first()
    assert r.COMMENTS == "two: b" and r.MERIT == 69 and r.SUN_DIST is None
    assert set(r.asDict()) == {"ts", *NOTICE_KEYS}


def test_messages_of_one_time_are_merged(spark):
    df = spark.createDataFrame([(1, "TITLE: a\nMERIT: 1"), (1, "TITLE: b")], "ts INT, msg STRING")
    assert rows(notices.pivot_notices(df, "msg", ["ts"], ["TITLE", "MERIT"])) == [(1, "b", "1")]


def test_comments_are_joined_in_order(notice):
    r = notices.joined_comments(notice, "msg").first()
    assert r.comments == "one two: b"
    assert r.all_text == "N, 1080.00 [sec]   (=18.0 [min]), 21:12:43 UT, 69.00, one two: b"


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("-30.147d {x}", "1080.00 [sec]   (=18.0 [min])", "inf"), ("none", "", "3")], "a STRING, b STRING, c STRING")
    got = df.select(first_number(F.col("a"), SIGNED_DEGREES), first_number(F.col("b"), MINUTES), finite(F.col("c")))
    assert [tuple(r) for r in got.collect()] == [(-30.147, 18.0, None), (None, None, 3.0)]


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (499, [499]), (500, [500]), (501, [500, 76]), (925, [500, 500]), (926, [500, 500, 76])])
def test_chunk_sizes(spark, n, sizes):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id INT, text STRING")
    got = documents.chunk(df, "text").orderBy("chunk_no").collect()
    assert [len(r.chunked_text.split()) for r in got] == sizes
    if len(got) > 1:
        assert got[0].chunked_text.split()[-75:] == got[1].chunked_text.split()[:75]
        assert got[-1].chunked_text.split()[-1] == f"w{n - 1}"


def test_empty_content_is_no_file(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, " ", " ")], "id INT, s STRING, t STRING")
    got = documents.file_table(df, ["s", "t"], "id", "f/", "id").collect()
    assert [(r.content, r.metadata.file_name, r.metadata.file_size) for r in got] == [("a b", "1.txt", 3)]


def test_event_classes(spark):
    texts = ["A Gravitational  wave from a merger", "nothing here", "GRB 240101: burst and optical counterpart",
             "supernova supernovae neutrino", "X-ray transient seen"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = [r.event_class for r in lexicon_classify(df, "text", EVENT_LEXICON).orderBy("id").collect()]
    assert got == ["gravitational wave", "other", "gamma-ray burst", "supernova", "fast X-ray transient"]
    assert set(EVENT_LEXICON) | {"other"} == set(EVENT_CLASSES)


def test_sentiment(spark):
    df = spark.createDataFrame([(1, "Good, GREAT day"), (2, "not bad"), (3, "a goodish day")], "id INT, text STRING")
    got = rows(lexicon_sentiment(df, "text"), "id", "sentiment_score", "sentiment")
    assert got == [(1, 2, "positive"), (2, -2, "negative"), (3, 0, "neutral")]


def test_contradicting_terms(spark):
    df = spark.createDataFrame([("return", 30), ("return", 365), ("refund", 14)], "topic STRING, days INT")
    assert rows(documents.contradicting_terms(df)) == [("return", 30, 365, 2)]


@pytest.mark.parametrize("pivots, rows_per_block, queries_per_block", [(None, 10_000, 1_000), (1, 20, 3), (60, 7, 4)])
def test_top_k_is_exact(spark, monkeypatch, pivots, rows_per_block, queries_per_block):
    monkeypatch.setattr(vectors, "ROWS_PER_BLOCK", rows_per_block)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", queries_per_block)
    rng = np.random.default_rng(1)
    corpus, asked = rng.normal(size=(300, 8)), rng.normal(size=(11, 8))
    corpus[100:200] = corpus[100] + rng.normal(size=(100, 8)) * .01      # a third of all rows in one place
    asked[3], asked[4] = corpus[150] * 2, 0.0
    corpus[5] = 0.0
    corpus[7] = corpus[9]                       # a tie, won by the smaller id
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)] + [(999, None)], "id LONG, embedding ARRAY<FLOAT>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id LONG, embedding ARRAY<DOUBLE>")
    got = {}
    for r in cosine_topk(c, q, 6, vectors.in_cells(c, pivots)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    m = corpus.astype("float32").astype("float64")
    norm = np.linalg.norm(m, axis=1)
    own = np.linalg.norm(asked, axis=1, keepdims=True)
    scores = np.round((asked / np.where(own == 0, 1, own)) @ (m / np.where(norm == 0, 1, norm)[:, None]).T, 12)
    for i in range(len(asked)):
        best = sorted(range(300), key=lambda j: (-scores[i, j], j))[:6]
        assert [x for _, x in sorted(got[i])] == best


def test_fewer_rows_than_asked_for(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id LONG, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id LONG, embedding ARRAY<DOUBLE>")
    assert rows(cosine_topk(c, q, 5), "query_id", "id", "rank") == [(1, 1, 1), (1, 2, 2)]
    assert cosine_topk(c.limit(0), q, 5).count() == 0 and cosine_topk(c, q.limit(0), 5).count() == 0


def test_far_cells_are_skipped(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    points = [(i, (centres[i % 20] + rng.normal(size=16) * .05).tolist()) for i in range(2000)]
    c = spark.createDataFrame(points, "id LONG, embedding ARRAY<DOUBLE>")
    q = c.filter("id < 40").withColumnRenamed("id", "query_id")
    assert vectors.compared_share(c, q, 5) < .2


def test_context_follows_the_ranks(spark):
    top = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "query_id LONG, id LONG, rank INT")
    texts = spark.createDataFrame([(10, "second"), (11, "first")], "id LONG, text STRING")
    assert retrieval_context(top, texts).first().context == "first\n\nsecond"
