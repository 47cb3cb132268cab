"""Boosted-tree models with Spark ML: training, evaluation, batch scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from weir.operators import boosting

SEED = 42
TASK_ROWS = 4_000_000          # training rows of one task, each some 15 bytes when stored


def without_gaps(df: DataFrame, numeric: list[str], means: dict[str, float]) -> DataFrame:
    """Missing numbers take the training mean, so that every row can be scored."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(means[c]))) for c in numeric})


def training_means(train: DataFrame, numeric: list[str]) -> dict[str, float]:
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in numeric}


def in_tasks(train: DataFrame, columns: list[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``columns`` of ``train``, dealt so that no task holds many more than ``task_rows`` of its ``rows``,
    which a split of a file may outgrow."""
    train, tasks = train.select(*columns), -(-rows // task_rows)
    return train if train.rdd.getNumPartitions() >= tasks else train.repartition(tasks)


def fit_regressor(train: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 4) -> PipelineModel:
    """Boosted trees for squared error, fitted over packed blocks (``boosting``) that are dealt to tasks."""
    model = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, seed=SEED)
    rows = train.select(*[F.col(c).cast("double") for c in [*features, target]])
    total, edges = boosting.thresholds(rows, model.getMaxBins())
    blocks = in_tasks(boosting.packed(rows, edges), boosting.PACKED, total)
    # a tree takes a pass per level: many short tasks would spend it on starting, a last few on waiting
    cores = train.sparkSession.sparkContext.defaultParallelism
    blocks = blocks.coalesce(cores * -(-total // (cores * TASK_ROWS)))
    made = boosting.boosted(blocks, edges, trees, depth, model.getStepSize(), model.getMaxBins())
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return PipelineModel([assembled, _spark_model(train.sparkSession, model, made, edges)])


def _spark_model(spark, estimator: GBTRegressor, made: list[boosting.Tree], edges: list) -> GBTRegressionModel:
    """``made`` as the model that ``estimator`` would return."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    ml, impurity = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity

    def listed(kind, values):
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    def node(tree: boosting.Tree, level: int, j: int):
        width = len(tree.ends[0]) >> level
        n, s, q = (float(x) for x in tree.ends[:, j * width:(j + 1) * width].sum(axis=-1))
        mean = s / n
        spread = max(q / n - mean * mean, 0.0)
        stats = impurity.VarianceCalculator(listed(jvm.double, [n, s, q]), int(n))
        split = tree.levels[level][j] if level < len(tree.levels) else None
        if split is None:
            return ml.tree.LeafNode(mean, spread, stats)
        f, b, gain = split
        return ml.tree.InternalNode(
            mean, spread, gain, node(tree, level + 1, 2 * j), node(tree, level + 1, 2 * j + 1),
            ml.tree.ContinuousSplit(f, float(edges[f][b])), stats)

    kind = ml.regression.DecisionTreeRegressionModel
    roots = [kind(f"{estimator.uid}_{i}", node(t, 0, 0), len(edges)) for i, t in enumerate(made)]
    weights = [1.0] + [estimator.getStepSize()] * (len(made) - 1)
    java = ml.regression.GBTRegressionModel(estimator.uid, listed(kind, roots), listed(jvm.double, weights), len(edges))
    return estimator._copyValues(GBTRegressionModel(java))


def fit_classifier(
    train: DataFrame, numeric: list[str], categories: list[str], target: str, trees: int = 10, depth: int = 3,
) -> PipelineModel:
    """Numbers as given (see ``fit_scaling``), categories one-hot; unseen categories are allowed."""
    stages = []
    for c in categories:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v"))
    stages.append(VectorAssembler(
        inputCols=[*numeric, *[f"{c}_v" for c in categories]], outputCol="features", handleInvalid="keep"))
    stages.append(GBTClassifier(labelCol=target, maxIter=trees, maxDepth=depth, seed=SEED))
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Every row with the model's prediction; fill gaps first (``without_gaps``)."""
    return model.transform(rows).drop("features", "rawPrediction", "probability")


def squared_error(scored: DataFrame, target: str) -> float:
    return RegressionEvaluator(labelCol=target, metricName="mse").evaluate(scored)


def f1_by_part(scored: DataFrame, part: str, target: str, guess: str, alias: str = "f1") -> DataFrame:
    """Per part the F1 of ``guess``, classes weighted by their labelled rows; NULL without labelled rows.

    One aggregate counts the pairs of label and guess; what follows works on those few rows.
    """
    pairs = scored.filter(F.col(target).isNotNull()).groupBy(part, target, guess).agg(F.count(F.lit(1)).alias("n"))
    classes = pairs.select(part, F.explode(F.array(
        F.struct(F.col(target).alias("c"), F.col("n").alias("held"), F.lit(0).alias("said"), F.when(F.col(target) == F.col(guess), F.col("n")).otherwise(0).alias("both")),
        F.struct(F.col(guess).alias("c"), F.lit(0).alias("held"), F.col("n").alias("said"), F.lit(0).alias("both")))).alias("x")).groupBy(
        part, "x.c").agg(*[F.sum(f"x.{k}").alias(k) for k in ("held", "said", "both")])
    return classes.groupBy(part).agg((
        F.sum(F.col("held") * 2 * F.col("both") / (F.col("held") + F.col("said"))) / F.sum("held")).alias(alias))


def f1(scored: DataFrame, target: str) -> float:
    return MulticlassClassificationEvaluator(labelCol=target, metricName="f1").evaluate(scored)
