"""Labels and sentiment from word lists, scored row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# word lists of this library (a model's labels can be joined in their place)
EVENT_LEXICON = {
    "gamma-ray burst": ["grb", "gamma ray burst", "burst"],
    "fast X-ray transient": ["x ray transient", "fxt", "x ray"],
    "gravitational wave": ["gravitational wave", "ligo", "merger"],
    "neutrino": ["neutrino", "neutrinos", "track event"],
    "supernova": ["supernova", "supernovae", "sn"],
    "optical transient": ["optical transient", "optical counterpart"],
}
SENTIMENT = {
    "positive": ["good", "great", "best", "excellent", "love", "thanks", "happy", "gut", "bien", "bueno"],
    "negative": ["no", "not", "never", "bad", "worst", "error", "nicht", "kein", "pas", "mal"],
}
_LETTERS = r"[^\p{L}]+"


def _hits(tokens: str, text: str, terms: list[str]) -> Column:
    single = [t for t in terms if " " not in t]
    phrases = [t for t in terms if " " in t]
    n = F.lit(0)
    if single:
        n = n + F.size(F.filter(tokens, lambda t: t.isin(*single)))
    if phrases:
        any_of = "|".join(p.replace(" ", r"[^\p{L}]+") for p in phrases)
        n = n + F.regexp_count(F.lower(text), F.lit(rf"(?<!\p{{L}})(?:{any_of})(?!\p{{L}})"))
    return n


def score(df: DataFrame, text: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """Adds ``_scores``: hits per label in lexicon order, from the whole text."""
    known = {t for terms in lexicon.values() for t in terms if " " not in t}
    # one pass keeps the few words that any label knows; the labels then look at those only
    words = F.filter(F.split(F.lower(text), _LETTERS), lambda t: t.isin(*sorted(known)))
    toks = df.withColumn("_tokens", words)
    scores = F.array(*[_hits("_tokens", text, terms) for terms in lexicon.values()])
    return toks.withColumn("_scores", scores).drop("_tokens")


def lexicon_classify(df, text: str, lexicon: dict[str, list[str]], default="other", alias="event_class") -> DataFrame:
    """The label with most hits, the first listed one on a tie, ``default`` without any hit."""
    labels = F.array(*[F.lit(l) for l in lexicon])
    best = F.array_max("_scores")
    label = F.when(best > 0, F.element_at(labels, F.array_position("_scores", best).cast("int"))).otherwise(default)
    return score(df, text, lexicon).withColumn(alias, label).drop("_scores")


def lexicon_sentiment(df: DataFrame, text: str, lexicon=SENTIMENT) -> DataFrame:
    """Positive minus negative words and the resulting mood."""
    words = {"positive": lexicon["positive"], "negative": lexicon["negative"]}
    diff = F.get("_scores", F.lit(0)) - F.get("_scores", F.lit(1))
    out = score(df, text, words).withColumn("sentiment_score", diff).drop("_scores")
    mood = F.when(F.col("sentiment_score") > 0, "positive").when(F.col("sentiment_score") < 0, "negative")
    return out.withColumn("sentiment", mood.otherwise("neutral"))
