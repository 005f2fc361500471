"""Cross-validation: folds, preparation, fit, evaluation, averages."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.aggregate import fold_summary
from sessiongrid.operators.metrics import confusion, long_metrics, macro_metrics
from sessiongrid.operators.models import Fit, predict
from sessiongrid.operators.ordered import column
from sessiongrid.operators.scaling import Components, Standardizer
from sessiongrid.operators.splits import apply_folds
from sessiongrid.operators.windows import tolerant_predictions
from sessiongrid.session import settle


def evaluate(
    predictions: DataFrame, label: str, keys: Sequence[str] = (), session: Sequence[str] = (),
    order: Sequence[str] = (), tolerance: int = 0,
) -> DataFrame:
    """Long metric rows of predictions; with a tolerance the ``_tolerant`` ones too."""
    plain = macro_metrics(confusion(predictions, label, "yhat", keys), keys)
    rows = long_metrics(plain, keys)
    if tolerance:
        near = tolerant_predictions(predictions, session, order, label, "yhat", tolerance, "_near")
        soft = long_metrics(macro_metrics(confusion(near, label, "_near", keys), keys), keys)
        rows = rows.unionByName(soft.withColumn("metric", F.concat("metric", F.lit("_tolerant"))))
    return rows


#: fits that are submitted together; Spark shares its cores among their jobs
AT_ONCE = 5


def prepare_fold(split: DataFrame, features: Sequence[str], flavour: str, fit_on: str) -> tuple[DataFrame, list[str]]:
    """Rows of one fold as clean, norm or pca, fitted on ``all`` rows or on ``train`` rows."""
    if flavour == "clean":
        return split, list(features)
    base = split.where(F.col("split") == "train") if fit_on == "train" else split
    if flavour == "norm":
        return Standardizer.fit(base, features).transform(split), list(features)
    if flavour == "pca":
        components = Components.fit(base, features)
        return components.transform(split), [f"pc{i + 1}" for i in range(components.count)]
    raise ValueError(f"flavour must be clean, norm or pca, not {flavour}")


def cross_validate(
    df: DataFrame, folds: DataFrame, entity: str, order: Sequence[str], features: Sequence[str], label: str, fit: Fit,
    count: int = 5, flavour: str = "clean", fit_on: str = "train", tolerance: int = 0, config_id: str = "0",
    balance=None,
) -> DataFrame:
    """Rows ``config_id, fold, split, metric, value`` for the val and test rows of every fold.

    ``balance(train)`` may resample the train rows. Every fit reads its rows several times, so the
    table and the folds are written once before. Folds are fitted side by side, AT_ONCE at a time, and the
    predictions of all folds are evaluated together.
    """
    df, folds = settle(df), settle(folds)

    def one(fold: int) -> DataFrame:
        split, names = prepare_fold(apply_folds(df, folds, entity, fold), features, flavour, fit_on)
        train = split.where(F.col("split") == "train")
        model = fit(balance(train) if balance else train, names, label)
        held = predict(model, split.where(F.col("split") != "train"), names)
        return held.select("fold", "split", *map(column, [entity, *order, label]), "yhat")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        results = list(pool.map(one, range(count)))
    predictions = reduce(lambda a, b: a.unionByName(b), results)
    held_out = settle(predictions) if tolerance else predictions
    rows = evaluate(held_out, label, ["fold", "split"], ["fold", "split", entity], order, tolerance)
    return rows.select(F.lit(config_id).alias("config_id"), "fold", "split", "metric", "value")


def average_folds(rows: DataFrame) -> DataFrame:
    return fold_summary(rows, ["config_id", "split", "metric"])


def cross_validate_within(
    df: DataFrame, entities: Sequence, entity: str, order: Sequence[str], features: Sequence[str], label: str, fit: Fit,
    train_share: float = 0.6,
) -> DataFrame:
    """A model per given entity on its own first rows, evaluated on its later rows."""
    from sessiongrid.operators.splits import within_entity_split

    results = []
    for one in entities:
        split = within_entity_split(df.where(column(entity) == F.lit(one)), entity, order, train_share)
        model = fit(split.where(F.col("split") == "train"), features, label)
        held = predict(model, split.where(F.col("split") != "train"), features)
        results.append(held.select(column(entity), "split", column(label), "yhat"))
    predictions = reduce(lambda a, b: a.unionByName(b), results)
    return evaluate(predictions, label, [entity, "split"])
