"""Spark ML classifiers on frame features: forests, layers, fusion, grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.functions.vectors import argmax, mean_vector, to_columns
from sessiongrid.operators.metrics import confusion, macro_metrics
from sessiongrid.operators.ordered import column, hash_order

Fit = Callable[[DataFrame, Sequence[str], str], Model]


def with_vector(df: DataFrame, features: Sequence[str], name: str = "_features") -> DataFrame:
    """Add the feature vector; names with dots are renamed for the assembler only."""
    renamed = {f"_in{i}": column(f).cast("double") for i, f in enumerate(features)}
    assembler = VectorAssembler(inputCols=list(renamed), outputCol=name)
    return assembler.transform(df.withColumns(renamed)).drop(*renamed)


def _fit_kept(estimator, train: DataFrame, features: Sequence[str], label: str, partitions: int | None) -> Model:
    """Fit on vectors kept for the time of the fit, which passes over them many times."""
    rows = train.select(*map(column, features), column(label))
    vectors = with_vector(rows.repartition(partitions) if partitions else rows, features).select("_features", column(label))
    vectors.persist()
    try:
        return estimator.fit(vectors)
    finally:
        vectors.unpersist()


def forest(trees: int = 100, depth: int = 10, seed: int = 42, partitions: int | None = None) -> Fit:
    """A random forest. ``partitions`` spreads the train rows evenly before the many passes over them."""

    def fit(train: DataFrame, features: Sequence[str], label: str) -> Model:
        model = RandomForestClassifier(
            featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed
        )
        return _fit_kept(model, train, features, label, partitions)

    return fit


def layers(
    classes: int, hidden: Sequence[int] = (64, 128, 64), rounds: int = 100, seed: int = 42, partitions: int | None = None
) -> Fit:
    """Dense layers between the features and the classes."""

    def fit(train: DataFrame, features: Sequence[str], label: str) -> Model:
        sizes = [len(features), *hidden, classes]
        model = MultilayerPerceptronClassifier(
            featuresCol="_features", labelCol=label, layers=sizes, maxIter=rounds, seed=seed
        )
        return _fit_kept(model, train, features, label, partitions)

    return fit


def predict(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Input rows with ``yhat`` and the probability array ``p``."""
    scored = model.transform(with_vector(df, features))
    return scored.select(
        *map(column, df.columns), F.col("prediction").cast("int").alias("yhat"), vector_to_array("probability").alias("p")
    )


def probability_columns(predictions: DataFrame, classes: int) -> DataFrame:
    rest = [column(c) for c in predictions.columns if c != "p"]
    return predictions.select(*rest, *to_columns(F.col("p"), classes, "class_"))


def importance_rows(spark: SparkSession, model: Model, features: Sequence[str], fold: int) -> DataFrame:
    """One row per feature: as many as the model is wide."""
    values = model.featureImportances.toArray()
    rows = [(fold, f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "fold INT, feature STRING, importance DOUBLE")


def mean_importances(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def grid_search(
    df: DataFrame, features: Sequence[str], label: str, fold: str, trees: Sequence[int], depths: Sequence[int],
    leaves: Sequence[int] = (1,), seed: int = 42, parallelism: int = 2, metric: str = "accuracy",
) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated grid over a forest; ``fold`` is a column of fold numbers from 0.

    Returns the model refitted with the best setting and the table of settings and means.
    """
    model = RandomForestClassifier(featuresCol="_features", labelCol=label, seed=seed)
    grid = (
        ParamGridBuilder()
        .addGrid(model.numTrees, list(trees))
        .addGrid(model.maxDepth, list(depths))
        .addGrid(model.minInstancesPerNode, list(leaves))
        .build()
    )
    folds = int(df.agg(F.max(column(fold))).first()[0]) + 1
    search = CrossValidator(
        estimator=model, estimatorParamMaps=grid, numFolds=folds, foldCol=fold, parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName=metric),
    )
    vectors = with_vector(df, features).select("_features", column(label), column(fold)).persist()
    found = search.fit(vectors)
    vectors.unpersist()
    rows = [
        (g[model.numTrees], g[model.maxDepth], g[model.minInstancesPerNode], float(m))
        for g, m in zip(grid, found.avgMetrics)
    ]
    table = df.sparkSession.createDataFrame(rows, f"trees INT, depth INT, min_leaf INT, {metric} DOUBLE")
    return found, table


def group_ablation(
    train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], label: str, fit: Fit
) -> DataFrame:
    """Metrics with all feature groups and without each one in turn."""
    every = [f for names in groups.values() for f in names]
    cases = {"all": every} | {f"no_{g}": [f for f in every if f not in set(names)] for g, names in groups.items()}
    results = [
        macro_metrics(confusion(predict(fit(train, names, label), test, names), label, "yhat")).select(
            F.lit(case).alias("features"), "*"
        )
        for case, names in cases.items()
    ]
    table = results[0]
    for result in results[1:]:
        table = table.unionByName(result)
    return table


def early_fusion(
    train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], chosen: Sequence[str], label: str, fit: Fit
) -> DataFrame:
    """One model on the features of all chosen groups."""
    names = [f for g in chosen for f in groups[g]]
    return predict(fit(train, names, label), test, names)


def late_fusion(
    train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], chosen: Sequence[str], label: str, fit: Fit
) -> DataFrame:
    """One model per group; class of the mean probability vector.

    All models score the same rows one after the other, so no join brings predictions together.
    """
    scored = test
    for g in chosen:
        names = list(groups[g])
        scored = predict(fit(train, names, label), scored, names).withColumnsRenamed({"p": f"_p_{g}"}).drop("yhat")
    fused = scored.withColumn("p", mean_vector([F.col(f"_p_{g}") for g in chosen]))
    return fused.withColumn("yhat", argmax(F.col("p"))).drop(*[f"_p_{g}" for g in chosen])


def block_fusion(
    train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], chosen: Sequence[str], label: str, fit: Fit,
    variance: float = 0.9,
) -> DataFrame:
    """Each group reduced to its own components on train rows, then one model on all blocks."""
    from sessiongrid.operators.scaling import Components

    names: list[str] = []
    for g in chosen:
        block = Components.fit(train, list(groups[g]), variance)
        train, test = block.transform(train, f"{g}_pc"), block.transform(test, f"{g}_pc")
        names += [f"{g}_pc{i + 1}" for i in range(block.count)]
    return predict(fit(train, names, label), test, names)


def majority_predictions(split: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """Test rows of every fold with the majority class of that fold's train rows as ``yhat``.

    The majorities are one row per fold, which Spark broadcasts if they are small.
    """
    counts = split.where(F.col("split") == "train").groupBy(column(fold), column(label)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    chosen = counts.groupBy(column(fold)).agg(
        F.min_by(column(label), F.struct(-F.col("_n"), column(label))).alias("yhat")
    )
    return split.where(F.col("split") == "test").join(chosen, fold)


def config_grid(base: DataFrame, axes: Mapping[str, Sequence[Any]], keep: str | None = None) -> DataFrame:
    """All combinations of the axes that satisfy ``keep``, for every row of ``base``.

    Axes unfold one after the other in place, without a join.
    """
    grid = base
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid if keep is None else grid.where(keep)


def modality_flags(names: Sequence[str]) -> dict[str, list[bool]]:
    """Axes for every combination of on/off flags; filter with :func:`any_flag`."""
    return {name: [True, False] for name in names}


def any_flag(names: Sequence[str]) -> str:
    return " OR ".join(names)


def shuffled_configs(grid: DataFrame, axes: Sequence[str], seed: int | str, count: int | None = None) -> DataFrame:
    """Configurations in hash order; with ``count`` the first ones, a random search."""
    ordered = grid.withColumn("config_id", hash_order(seed, *axes)).orderBy("config_id")
    return ordered if count is None else ordered.limit(count)
