"""Boosted-tree models on the daily sales and on the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.operators import features as ft, models
from weir.operators.sampling import hash_split
from weir.plans.features import SERIES, filled
from weir.registry import ORACLES, query
from weir.session import pinned
from weir.tables import load


_SPLIT = """CASE WHEN b < 52428 THEN 'train' WHEN b < 58982 THEN 'validation' ELSE 'test' END"""
_MD5 = "CAST(('0x' || substr(md5({}), 1, 4)) AS INTEGER)"


def _report(rows: DataFrame, split: str, target: str, base: DataFrame, model: str) -> DataFrame:
    """Per part: rows, scored rows, and whether the model errs less than the constant ``base`` on the
    training rows and at most a quarter more than it on others (the test series are noise, so
    nothing can beat their mean there)."""
    error = (F.col(target) - F.col("prediction")) ** 2
    return rows.crossJoin(F.broadcast(base)).groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("scored"),
        F.avg(error).alias("_error"), F.avg((F.col(target) - F.col("base")) ** 2).alias("_base")).withColumns({
            "holds": F.col("_error") < F.col("_base") * F.when(F.col(split) == "train", 1.0).otherwise(1.25), "model": F.lit(model)})


@query("gbt_forecast", f"""
  SELECT 'units' AS model, split, count(*) AS rows, count(*) AS scored, true AS holds FROM (
    SELECT CASE WHEN {_MD5.format("franchise_id || '|' || product || '|' || transaction_date")} < 52428 THEN 'train' ELSE 'test' END AS split
    FROM ({ORACLES["lag_features_filled"]})) GROUP BY split""")
def forecast(spark, d) -> DataFrame:
    """Next-day units per store and product: every day scored once, the error compared with that of
    the training mean on the days held back and on those trained on."""
    cols = [*ft.lag_columns(), "units_sold", "dow"]
    keyed = filled(spark, d).withColumn("_k", F.concat_ws("|", *SERIES, "transaction_date"))
    parts = pinned(hash_split(keyed, "_k", {"train": 0.8, "test": 0.2}).select("split", *cols, "target_units_sold"), "series")
    train = parts.filter("split = 'train'")
    means = models.training_means(train, cols)
    model = models.fit_regressor(models.without_gaps(train, cols, means), cols, "target_units_sold")
    scored = models.score(model, models.without_gaps(parts, cols, means))
    base = train.agg(F.avg("target_units_sold").alias("base"))
    return _report(scored, "split", "target_units_sold", base, "units").select("model", "split", "rows", "scored", "holds")


def scored_documents(spark, d) -> DataFrame:
    """``doc_id, split, quality, prediction`` of every document, from length, word counts and source:
    fitted on the training part, its scaling too."""
    docs = load(spark, d, "documents").select(
        "doc_id", "lang", F.col("n_chars").alias("chars"),
        F.size(F.split("text", r"\s+")).alias("words"), F.size(F.split("text", "\n")).alias("lines"))
    rows = pinned(docs.join(load(spark, d, "labels").select("doc_id", F.col("quality").cast("double")), "doc_id", "left"), "labelled")
    parts = hash_split(rows, "doc_id", {"train": 0.8, "validation": 0.1, "test": 0.1}).withColumn(
        "split", F.when(F.col("quality").isNull(), "unlabelled").otherwise(F.col("split")))
    numeric, train = ["chars", "words", "lines"], F.col("split") == "train"
    scaling = ft.fit_scaling(parts.filter(train), numeric)
    model = models.fit_classifier(scaling.transform(parts.filter(train)), numeric, ["lang"], "quality")
    return models.score(model, scaling.transform(parts)).select("doc_id", "split", "quality", "prediction")


def class_report(scored: DataFrame) -> DataFrame:
    """Per part of ``scored(split, quality, prediction)``: rows, scored rows, and whether the model is
    right at least as often as the commoner class of the training part, and has at least its F1.  A part
    without labels holds nothing against it."""
    base = scored.filter("split = 'train'").agg(F.round(F.avg("quality")).alias("base"))
    right = lambda guess: F.avg((F.col("quality") == F.col(guess)).cast("double"))
    both = scored.crossJoin(F.broadcast(base))
    report = both.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("scored"),
        F.coalesce(right("prediction") >= right("base"), F.count("quality") == 0).alias("no_worse_than_constant"))
    f1s = models.f1_by_part(both, "split", "quality", "prediction").join(
        models.f1_by_part(both, "split", "quality", "base", "base_f1"), "split")
    better = F.coalesce(F.col("f1") >= F.col("base_f1"), F.lit(True)).alias("f1_no_worse")
    return report.join(f1s, "split", "left").select(*report.columns, better)


@query("gbt_classify", f"""
  SELECT 'quality' AS model, split, count(*) AS rows, count(*) AS scored, true AS no_worse_than_constant, true AS f1_no_worse FROM (
    SELECT CASE WHEN quality IS NULL THEN 'unlabelled' ELSE {_SPLIT} END AS split FROM (
      SELECT quality, {_MD5.format("CAST(d.doc_id AS VARCHAR)")} AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)) GROUP BY split""")
def classify(spark, d) -> DataFrame:
    """Document quality: every document scored once (``scored_documents``), compared with the commoner
    class of the training part on every part that has labels."""
    scored = pinned(scored_documents(spark, d), "scored")
    return class_report(scored).select(F.lit("quality").alias("model"), "split", "rows", "scored", "no_worse_than_constant", "f1_no_worse")
