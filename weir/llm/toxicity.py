"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from weir.llm.common import per_text, pinned, text_or_empty
from weir.llm.words import Memo
from weir.llm.workers import give_back, make_room

SAMPLE = 20_000                # labelled rows the model is fitted on, at most
CANDIDATES = 20_000            # features of toxic texts that are looked at, at most
FEATURES = 1_000               # features with a weight, at most
EVIDENCE = 30.0                # likelihood ratio from which a feature is taken
RATE = 0.5                     # probability of the first grade from which a text is rejected
_words = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> tuple[str, ...]:
    """A word and its first four and five letters, as endings vary."""
    return (word, *("^" + word[:n] for n in (4, 5) if len(word) > n))


@dataclass(frozen=True)
class Model:
    """P(grade >= j) = 1 / (1 + exp(threshold_j - weights . x)), x the log of one plus the counts."""

    names: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) and so on, falling."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - x @ self.weights, -50, 50)))


def fit_ordinal(names, rows: list[dict[int, float]], grades: np.ndarray, levels: int, ridge: float = 0.1,
                steps: int = 600, rate: float = 0.05) -> Model:
    """Proportional odds: one weight vector for all thresholds, thresholds kept in order by positive
    gaps; penalised likelihood by full-batch Adam from zero, so equal rows give equal models."""
    n = len(names)
    row = np.array([i for i, r in enumerate(rows) for _ in r], dtype=np.int64)
    col = np.array([f for r in rows for f in r], dtype=np.int64)
    val = np.array([v for r in rows for v in r.values()], dtype=np.float64)
    theta = np.zeros(n + levels)                       # weights, first threshold, log gaps
    theta[n:] = np.log(0.5)
    theta[n] = 1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    index = np.arange(len(grades))
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.append(theta[n], np.exp(theta[n + 1:])))
        eta = np.bincount(row, weights=val * theta[col], minlength=len(grades)) if len(row) else np.zeros(len(grades))
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - eta[:, None], -50, 50)))
        tail = np.hstack([np.ones((len(grades), 1)), tail, np.zeros((len(grades), 1))])
        slope = tail * (1 - tail)
        p = np.maximum(tail[index, grades] - tail[index, grades + 1], 1e-12)
        d_eta = -(slope[index, grades] - slope[index, grades + 1]) / p
        d_cut = np.zeros(levels)
        for j in range(1, levels + 1):
            d_cut[j - 1] = np.sum((slope[:, j] / p)[grades == j]) - np.sum((slope[:, j] / p)[grades == j - 1])
        gradient = np.empty_like(theta)
        gradient[:n] = np.bincount(col, weights=val * d_eta[row], minlength=n) + ridge * theta[:n] if len(row) else ridge * theta[:n]
        later = np.cumsum(d_cut[::-1])[::-1]
        gradient[n] = later[0]
        gradient[n + 1:] = later[1:] * np.exp(theta[n + 1:])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(tuple(names), theta[:n].copy(), np.cumsum(np.append(theta[n], np.exp(theta[n + 1:]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``bound`` labelled texts, those with the least hash of the id; one label an id, the highest."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(
        F.max(label_col).alias("_label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(bound).select(F.col(id_col).alias("_id"), "_label")
    return pinned(docs.select(id_col, text_col).join(pinned(chosen, "labelled"), F.col(id_col) == F.col("_id")).select(
        F.col("_id").alias("id"), text_or_empty(text_col).alias("body"), (F.col("_label") > 0).cast("int").alias("toxic")), "sample")


def _tally(sample: DataFrame, wanted: frozenset | None, contexts: bool) -> DataFrame:
    """(feature, toxic, n): texts with a feature, or distinct neighbours that it stands between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        parts = Memo(lambda w: tuple(f for f in features_of(w) if wanted is None or f in wanted), 100_000)
        for batch in batches:
            found: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text.lower())
                if contexts:
                    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                        for f in parts[word]:
                            found[f, toxic, xxhash.xxh64_intdigest(f"{before} {after}") >> 1] = 1
                else:
                    found.update((f, toxic, 0) for f in {f for w in set(words) for f in parts[w]})
            names, flags, hashes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(flags, pa.int32()), pa.array(hashes, pa.int64()),
                 pa.array(found.values(), pa.int64())], names=["feature", "toxic", "context", "n"])

    rows = sample.select("body", "toxic").mapInArrow(run, "feature string, toxic int, context long, n long")
    if contexts:
        return rows.groupBy("feature", "toxic", "context").agg(F.first("n").alias("n")).groupBy("feature", "toxic").agg(
            F.sum("n").alias("n"))
    return rows.groupBy("feature", "toxic").agg(F.sum("n").alias("n"))


def _evidence(counts: list, totals: tuple[int, int], least: float) -> dict[str, float]:
    """Features that are commoner in toxic texts, with their likelihood ratio."""
    table: dict[str, list[int]] = {}
    for feature, toxic, n in counts:
        table.setdefault(feature, [0, 0])[toxic] = n
    out = {}
    clean, bad = totals
    for feature, (a, b) in table.items():
        share, whole = bad / (clean + bad), a + b
        if b / max(bad, 1) <= 3 * a / max(clean, 1):
            continue
        g = 2 * (b * np.log(b / (whole * share)) + (a * np.log(a / (whole * (1 - share))) if a else 0))
        if g >= least:
            out[feature] = float(g)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          bound: int = SAMPLE) -> Model:
    """A model of grades 0 (clean) to 3 from a bounded sample of labelled texts.

    Features are words and beginnings of words that toxic texts hold far more often, counted by texts
    and then by distinct neighbours, so that copies of one text are no evidence.  The grade of a toxic
    text is the third of the toxic texts it falls in by the number of such words.  Only the sample's
    counts come to the driver, bounded by CANDIDATES, FEATURES and ``bound``.  Without toxic labels
    nothing is rejected.
    """
    sample = labelled_sample(docs, labels, bound, id_col, text_col, label_col)
    sizes = {r.toxic: (r["n"], r["words"]) for r in sample.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("body", r"\s+"))).alias("words")).collect()}
    (clean, clean_words), (bad, bad_words) = sizes.get(0, (0, 0)), sizes.get(1, (0, 0))
    nothing = Model((), np.zeros(0), np.array([10.0, 11.0, 12.0]))
    if not bad:
        return nothing
    common = _tally(sample.filter("toxic = 1"), None, False).filter("n >= 4").orderBy(F.desc("n"), "feature").limit(CANDIDATES)
    candidates = frozenset(r.feature for r in common.collect())
    by_text = _evidence(_tally(sample, candidates, False).collect(), (clean, bad), EVIDENCE / 2)
    by_place = _evidence(_tally(sample, frozenset(by_text), True).collect(), (clean_words, bad_words), EVIDENCE)
    names = sorted(sorted(by_place, key=lambda f: (-by_place[f], f))[:FEATURES])
    if not names:
        return nothing
    rows = sorted(_counted(sample, names, ["id", "toxic"], "body").collect(), key=lambda r: (r.id, r.toxic, r.hits))
    hits = np.array([r.hits for r in rows])
    toxic = np.array([r.toxic for r in rows])
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0).astype(np.int64)
    found = [dict(zip(r["index"], np.log1p(r["count"]))) for r in rows]
    return fit_ordinal(names, found, grades, 3)


def _counted(docs: DataFrame, names: list[str], ids: list[str], text_col: str) -> DataFrame:
    """Sparse counts: ``index`` and ``count`` of the named features, ``hits``: words with any."""
    number = {f: i for i, f in enumerate(names)}

    def make():
        parts = Memo(lambda w: tuple(number[f] for f in features_of(w) if f in number), 100_000)

        def count(text: str):
            met = list(filter(None, map(parts.__getitem__, _words(text.lower()))))
            counts = sorted(Counter(i for found in met for i in found).items())
            return [i for i, _ in counts], [float(c) for _, c in counts], len(met)

        return count

    return per_text(docs, ids, text_col, "index array<int>, `count` array<double>, hits long", make)


def graded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Per row: id, ``p_toxic`` = P(grade >= 1), ``grade`` (the most grades with probability of a half or
    more), ``severity`` (expected grade) and ``rejected``.  Row-local.

    NULL and empty texts hold no feature and are scored as such.  Repeated rows are scored each, NULL
    ids are kept.  Other columns are left out, so names cannot clash.
    """
    number = {f: i for i, f in enumerate(model.names)}

    def make():
        parts = Memo(lambda w: tuple(number[f] for f in features_of(w) if f in number), 100_000)

        def score(text: str):
            met = list(filter(None, map(parts.__getitem__, _words(text.lower()))))
            x = np.zeros(len(number))
            for i, c in Counter(i for found in met for i in found).items():
                x[i] = np.log1p(c)
            p = model.probabilities(x)
            return float(p[0]), int((p >= 0.5).sum()), float(p.sum()), bool(p[0] >= rate)

        return score

    return per_text(docs, [id_col], text_col, "p_toxic double, grade int, severity double, rejected boolean", make)


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` without the texts that the model rejects, all columns kept.  Row-local: the decision is
    made beside the row, so rows of one id with different texts are decided each.  NULL and empty texts hold
    no feature and are decided as such.  Columns may have any names.  An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        number = {f: i for i, f in enumerate(model.names)}
        parts = Memo(lambda w: tuple(number[f] for f in features_of(w) if f in number), 100_000)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                counts = Counter(i for w in _words((text.as_py() or "").lower()) for i in parts[w])
                x = np.zeros(len(number))
                x[list(counts)] = np.log1p(list(counts.values()))
                keep.append(model.probabilities(x)[0] < rate)
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
