import random

import numpy as np
import pytest

from weir.llm.toxicity import Model, fit_ordinal, graded, train, without_toxic

WORDS = [a + b for a in "ba de fi go lu ma ne ri so tu".split() for b in "ka le mi no ru sa te vi zo".split()]
BAD = ["grumblo", "snarfe", "vexat", "drosk"]


def corpus(n, seed=0):
    """Documents, labels: toxic ones hold some of a few stems with changing endings."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "n"]) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.choice([1, 2, 5, 9]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "x", "ing", "ed"]))
        docs.append((i, " ".join(words).capitalize() + ".", toxic))
        labels.append((i, toxic, 1))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(1200)
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    return train(frame.drop("toxic"), known), frame, known


def test_held_out_documents_are_told_apart(spark, fitted):
    docs, labels = corpus(400, seed=9)
    frame = spark.createDataFrame([(d, t, t, "x") for d, t, _ in docs], "doc_id long, text string, grade string, index string")
    got = {r.doc_id: r for r in graded(frame, fitted[0]).collect()}
    toxic = dict((d, y) for d, y, _ in labels)
    wrong = sum(got[d].rejected != bool(y) for d, y in toxic.items())
    assert wrong <= 8
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in got.values())
    many = {d: t.lower().count("grumblo") + t.lower().count("snarfe") + t.lower().count("vexat") + t.lower().count("drosk") for d, t, _ in docs}
    mean = lambda lo, hi: np.mean([got[d].severity for d, n in many.items() if lo <= n <= hi])
    assert mean(0, 0) < mean(1, 2) < mean(5, 5) < mean(9, 9)


def test_fit_is_repeatable_and_bounded(fitted):
    model, frame, known = fitted
    again = train(frame.drop("toxic").repartition(2), known)
    assert again.names == model.names and np.array_equal(again.weights, model.weights)
    assert list(model.thresholds) == sorted(model.thresholds)
    assert train(frame.drop("toxic"), known, bound=50).names == train(frame.drop("toxic"), known, bound=50).names


def test_ordinal_fit_gives_the_shares_of_the_grades():
    """Without features the thresholds are the log odds of the grades' shares."""
    grades = np.repeat([0, 1, 2, 3], [50, 25, 15, 10])
    model = fit_ordinal([], [{} for _ in grades], grades, 3, steps=3000)
    assert np.allclose(1 / (1 + np.exp(model.thresholds)), [0.5, 0.25, 0.1], atol=1e-3)


def test_ordinal_weights_grow_with_the_grade():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 800)
    grades = np.minimum(3, np.maximum(0, x + rng.integers(-1, 2, 800)))
    model = fit_ordinal(["f"], [{0: float(v)} if v else {} for v in x], grades, 3)
    severity = [model.probabilities(np.array([float(v)])).sum() for v in range(4)]
    assert severity == sorted(severity) and model.weights[0] > 1


def test_odd_rows(spark, fitted):
    model = fitted[0]
    rows = [(1, None), (1, None), (2, ""), (None, "grumblo snarfe vexat drosk grumblox"), (3, "baka " * 50_000), (4, "漢字 ½ \x00")]
    frame = spark.createDataFrame([(d, t, 1.0, "r") for d, t in rows], "doc_id long, text string, severity double, rejected string")
    got = graded(frame, model).collect()
    assert sorted((r.doc_id or 0, r.rejected) for r in got) == [(0, True), (1, False), (1, False), (2, False), (3, False), (4, False)]
    kept = without_toxic(frame, model)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 3, 4]
    assert graded(frame.limit(0), model).collect() == []


def test_labels_without_toxic_reject_nothing(spark, fitted):
    _, frame, known = fitted
    for labels in (known.filter("toxic = 0"), known.limit(0), known.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic")):
        model = train(frame.drop("toxic"), labels)
        assert isinstance(model, Model) and without_toxic(frame, model).count() == frame.count()
