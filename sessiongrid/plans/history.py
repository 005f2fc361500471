"""Training in steps: what a fit reached after each iteration, as rows of the long metrics table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.aggregate import best_epoch
from sessiongrid.operators.metrics import confusion, long_metrics, macro_metrics
from sessiongrid.operators.models import predict, with_vector
from sessiongrid.operators.ordered import column
from sessiongrid.session import settle


@dataclass(frozen=True)
class Training:
    """``history`` has ``config_id, epoch, split, metric, value``; ``models`` the model after each step, by epoch."""

    history: DataFrame
    models: dict[int, MultilayerPerceptronClassificationModel]

    def best(self, metric: str = "accuracy") -> tuple[int, MultilayerPerceptronClassificationModel]:
        """The epoch with the greatest value on held-out rows, the later one of equal ones, and its model."""
        held = self.history.where((F.col("split") == "val") & (F.col("metric") == metric))
        epoch = best_epoch(held, first_epoch=0).first()["best_epoch"]
        return epoch, self.models[epoch]


def train_in_steps(
    train: DataFrame, held: DataFrame, features: Sequence[str], label: str, classes: int, hidden: Sequence[int] = (64, 128, 64),
    steps: int = 10, rounds: int = 10, seed: int = 42, config_id: str = "0",
) -> Training:
    """Dense layers fitted for ``steps`` times ``rounds`` iterations, each step going on from the weights before.

    The loss on the train rows is noted for every iteration, the metrics on the held-out rows after every step. A step
    that ends early, having converged, ends the training. The vectors are written once; the models of all steps
    score the held-out rows in one pass, so the driver holds weights and losses alone.
    """
    spark = train.sparkSession
    vectors = settle(with_vector(train, features).select("_features", column(label)))
    sizes, losses, models, weights, done = [len(features), *hidden, classes], [], {}, None, 0
    for _ in range(steps):
        layers = MultilayerPerceptronClassifier(featuresCol="_features", labelCol=label, layers=sizes, maxIter=rounds, seed=seed)
        model = (layers if weights is None else layers.setInitialWeights(weights)).fit(vectors)
        reached = [float(v) for v in model.summary().objectiveHistory]
        # the first loss of a later step is the last one of the step before
        losses += [(done + i, v) for i, v in enumerate(reached) if i or not done]
        if done and len(reached) == 1:
            break
        done, weights = done + len(reached) - 1, model.weights
        models[done] = model
        if len(reached) <= rounds:
            break
    curve = spark.createDataFrame(losses, "epoch int, value double").select("epoch", F.lit("train").alias("split"), F.lit("loss").alias("metric"), "value")
    scored = held
    for epoch, model in models.items():
        scored = predict(model, scored, features).withColumnsRenamed({"yhat": f"_yhat_{epoch}"}).drop("p")
    calls = F.array(*[F.struct(F.lit(epoch).alias("epoch"), F.col(f"_yhat_{epoch}").alias("yhat")) for epoch in models])
    calls = scored.select(column(label), F.inline(calls))
    metrics = long_metrics(macro_metrics(confusion(calls, label, "yhat", ["epoch"]), ["epoch"]), ["epoch"])
    rows = [curve, metrics.select("epoch", F.lit("val").alias("split"), "metric", "value")]
    history = reduce(lambda a, b: a.unionByName(b), rows).select(F.lit(config_id).alias("config_id"), "epoch", "split", "metric", "value")
    return Training(settle(history), models)
