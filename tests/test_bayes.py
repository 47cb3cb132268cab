"""Learnt labels against the formula, and on words that tell the labels apart."""

import math
import random
import re
from collections import Counter

import pytest
from weir.operators import bayes

SCHEMA = "id long, text string, label string"


def brute(train, texts):
    by = {}
    for _, text, label in train:
        if label is not None:
            by.setdefault(label, []).append(Counter((text or "").lower().split()))
    seen = {w for docs in by.values() for c in docs for w in c}
    n_texts = sum(map(len, by.values()))
    out = {}
    for i, text, _ in texts:
        scores = {}
        for label, docs in by.items():
            counts = sum(docs, Counter())
            scores[label] = math.log(len(docs) / n_texts) + sum(
                n * (math.log(counts[w] + 1) - math.log(sum(counts.values()) + len(seen) + 1))
                for w, n in Counter((text or "").lower().split()).items())
        best = max(round(s, 9) for s in scores.values())
        out[i] = min(x for x, s in scores.items() if round(s, 9) == best)
    return out


def test_equals_the_formula(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("red blue green Sky tree stone".split()) for _ in range(rng.randint(0, 9))), rng.choice(["a", "b", "c", None]))
             for i in range(60)] + [(60, None, "a"), (61, "", None), (62, "unseen words only", None)]
    model = bayes.fit(spark.createDataFrame(texts[:50], SCHEMA), "id", "text", "label")
    got = {r.id: r.label for r in model.classify(spark.createDataFrame(texts, SCHEMA), "id", "text").collect()}
    assert got == brute(texts[:50], texts)


def test_tells_labels_apart(spark):
    rng = random.Random(2)
    words = {"x": ["apple", "pear", "plum"], "y": ["iron", "zinc", "lead"]}
    texts = []
    for i in range(300):
        label = rng.choice("xy")
        texts.append((i, " ".join(rng.choice(words[label] if rng.random() < .6 else ["the", "a", "of"]) for _ in range(8)), label))
    model = bayes.fit(spark.createDataFrame(texts[:200], SCHEMA), "id", "text", "label")
    got = {r.id: r.label for r in model.classify(spark.createDataFrame(texts[200:], SCHEMA), "id", "text").collect()}
    assert sum(got[i] == label for i, _, label in texts[200:]) > 95


def test_no_labels_is_an_error(spark):
    with pytest.raises(ValueError):
        bayes.fit(spark.createDataFrame([(1, "a", None)], SCHEMA), "id", "text", "label")


def test_only_uncommon_words_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(bayes, "COMMON", 2)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("red red red blue blue green stone".split()) for _ in range(9)), rng.choice("ab")) for i in range(40)]
    frame = spark.createDataFrame(texts, SCHEMA)
    model = bayes.fit(frame, "id", "text", "label")
    assert sorted(r.word for r in model.common.collect()) == ["blue", "red"]
    found = model.classify(frame, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\w+, word#", plan) and "SortMergeJoin [word#" in plan
    assert {r.id: r.label for r in found.collect()} == brute(texts, texts)


def test_rows_of_one_id_are_one_text_with_all_their_labels(spark):
    rows = [(1, "red", "a"), (1, "blue", "b"), (2, "blue blue", "b"), (None, "green", "a"), (3, "stone", "a")]
    model = bayes.fit(spark.createDataFrame(rows, SCHEMA), "id", "text", "label")
    weights = {r.word: [round(math.exp(w)) - 1 for w in r.w] for r in model.weights.collect()}
    assert weights == {"red": [1, 1], "blue": [1, 3], "stone": [1, 0]}
    got = model.classify(spark.createDataFrame([*rows, (None, "stone", None)], SCHEMA), "id", "text").collect()
    assert len({r.label for r in got if r.id == 1}) == 1 and len({r.label for r in got if r.id is None}) == 1 and len(got) == 6
