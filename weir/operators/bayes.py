"""Text labels learnt from labelled rows: multinomial naive Bayes on word counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weir.session import pinned

_LETTERS = r"[^\p{L}]+"
COMMON = 50_000                # commonest words, whose weights are sent to the texts


def words(text: str) -> Column:
    """The words of a whole text in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _LETTERS), lambda w: w != "")


@dataclass(frozen=True)
class Bayes:
    """Labels in order, their prior and the weight of a word they do not know, and a stored table of
    the words of all labels with one weight per label, relative to that of an unknown word.  ``common``
    holds the commonest of them, at most COMMON."""

    labels: list[str]
    priors: list[float]
    unknown: list[float]
    weights: DataFrame
    common: DataFrame

    def classify(self, df: DataFrame, id_col: str, text: str, alias: str = "label") -> DataFrame:
        """``id_col`` and the likeliest label of every row, the smaller label on a tie.  A text without
        words gets the likeliest label beforehand.  Rows of one id are one text.

        Common words meet their weights beside the text, and its sums are one row before the shuffle.  Only
        the others are shuffled, to the table of all words, which grows and is not broadcast.
        """
        every = df.select(F.col(id_col).alias("id"), F.explode(words(text)).alias("word"))
        sums = [F.sum(F.coalesce(F.get("w", F.lit(i)), F.lit(0.0)) + F.lit(u)).alias(f"s{i}") for i, u in enumerate(self.unknown)]
        common = F.broadcast(self.common)
        near = every.join(common, "word").groupBy("id").agg(*sums)
        far = every.join(common, "word", "left_anti").join(self.weights.hint("merge"), "word", "left").groupBy("id").agg(*sums)
        scored = near.unionByName(far).groupBy("id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(self.labels))])
        rows = df.select(F.col(id_col).alias("_id")).join(scored, F.col("_id").eqNullSafe(F.col("id")), "left")
        scores = F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.lit(p) for i, p in enumerate(self.priors)])
        names = F.array(*[F.lit(label) for label in self.labels])
        best = F.array_position(scores, F.array_max(scores)).cast("int")
        return rows.select(F.col("_id").alias(id_col), F.element_at(names, best).alias(alias))


def fit(labelled: DataFrame, id_col: str, text: str, label: str) -> Bayes:
    """Word counts per label with one added to each, by Spark aggregates over all labelled rows.

    Rows without a label are left out.  To the driver come the labels and three numbers for each; the
    vocabulary stays a table, with a row per word.  Words are combined with their label before the shuffle;
    texts move only where ids are repeated: each row of an id then gives its label to all words of the id.
    """
    rows = labelled.filter(F.col(label).isNotNull())
    named = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    texts = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    if not named.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        texts = texts.drop("label").join(named, "id")
    by_word = pinned(texts.select("label", F.explode(words("text")).alias("word")).groupBy("word", "label").agg(
        F.count(F.lit(1)).alias("n")), "words")
    size = by_word.select("word").distinct().count()
    totals = {r["label"]: r["n"] for r in by_word.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    texts = {r["label"]: r["n"] for r in rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(texts)
    if not labels:
        raise ValueError("no labelled rows")
    logs = rows.sparkSession.range(1).select(*[
        F.log(F.lit(texts[x] / sum(texts.values()))).alias(f"p{i}") for i, x in enumerate(labels)], *[
        F.log(F.lit(1.0 / (totals.get(x, 0) + size + 1))).alias(f"u{i}") for i, x in enumerate(labels)]).first()
    seen = [F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)) for x in labels]
    weights = pinned(by_word.groupBy("word").agg(F.array(*[F.log(s + 1.0) for s in seen]).alias("w"), F.sum("n").alias("n")), "weights")
    common = pinned(weights.orderBy(F.desc("n"), "word").limit(COMMON).select("word", "w"), "common")
    return Bayes(labels, [logs[f"p{i}"] for i in range(len(labels))], [logs[f"u{i}"] for i in range(len(labels))],
                 weights.select("word", "w"), common)
