"""Standardising and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.functions.vectors import to_columns
from sessiongrid.operators.ordered import column


@dataclass(frozen=True)
class Standardizer:
    """Mean and population sd per feature; a constant feature becomes 0, a feature without values stays null."""

    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], scale: bool = True) -> Standardizer:
        """One aggregate over all features; only two numbers per feature reach the driver."""
        aggregates = [F.count(F.lit(1)).alias("rows")] + [F.avg(column(f)).alias(f"m{i}") for i, f in enumerate(features)]
        if scale:
            aggregates += [F.stddev_pop(column(f)).alias(f"s{i}") for i, f in enumerate(features)]
        row = df.agg(*aggregates).first()
        if not row["rows"]:
            raise ValueError("cannot standardise an empty table")
        means = {f: row[f"m{i}"] for i, f in enumerate(features)}
        return cls(means, {f: row[f"s{i}"] if scale else 1.0 for i, f in enumerate(features)})

    def scaled(self, feature: str) -> Column:
        sd = self.deviations[feature]
        if self.means[feature] is None:
            return F.lit(None).cast("double")
        if not sd:
            return F.when(column(feature).isNotNull(), F.lit(0.0))
        return (column(feature) - F.lit(self.means[feature])) / F.lit(sd)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: self.scaled(f) for f in self.means})


def standardize(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise with the moments of the whole table, or of ``fit_on`` (train rows)."""
    return Standardizer.fit(df if fit_on is None else fit_on, features).transform(df)


def standardize_per_fold(df: DataFrame, features: Sequence[str], fold: str = "fold", split: str = "split") -> DataFrame:
    """Every fold standardised with its own train rows: one aggregate for all folds.

    The moments are one row per fold, which Spark broadcasts if they are small.
    """
    moments = df.where(column(split) == "train").groupBy(column(fold)).agg(
        *[F.avg(column(f)).alias(f"_m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(column(f)).alias(f"_s{i}") for i, f in enumerate(features)],
    )
    scaled = {
        f: F.when(F.col(f"_s{i}") > 0, (column(f) - F.col(f"_m{i}")) / F.col(f"_s{i}")).when(column(f).isNotNull(), 0.0)
        for i, f in enumerate(features)
    }
    return df.join(moments, fold).withColumns(scaled).select(*map(column, df.columns))


@dataclass(frozen=True)
class Components:
    """Leading principal components that keep a wanted share of the variance."""

    standardizer: Standardizer
    model: PCAModel
    count: int
    signs: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], variance: float = 0.9, scale: bool = True) -> Components:
        """Centre (and scale), fit, and take the fewest components beyond ``variance``.

        The covariance is d × d on the driver. Each component's largest loading is made positive.
        """
        standardizer = Standardizer.fit(df, features, scale)
        model = PCA(k=len(features), inputCol="_v", outputCol="_pc").fit(_assembled(df, standardizer))
        reached = np.cumsum(model.explainedVariance.toArray())
        count = min(int(np.searchsorted(reached, variance, side="right")) + 1, len(features))
        loadings = model.pc.toArray()
        largest = np.abs(loadings).argmax(axis=0)
        signs = np.sign(loadings[largest, np.arange(loadings.shape[1])])
        return cls(standardizer, model, count, tuple(float(s) for s in signs[:count]))

    def loadings(self) -> np.ndarray:
        return self.model.pc.toArray()[:, : self.count] * np.array(self.signs)

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Features replaced by ``pc1…pck``; other columns stay."""
        features = list(self.standardizer.means)
        rest = [c for c in df.columns if c not in features]
        raw = vector_to_array("_pc")
        signs = F.array(*[F.lit(s) for s in self.signs])
        turned = F.zip_with(F.slice(raw, 1, self.count), signs, lambda x, s: x * s)
        projected = self.model.transform(_assembled(df, self.standardizer)).withColumn("_t", turned)
        names = [c.alias(f"{prefix}{i + 1}") for i, c in enumerate(to_columns(F.col("_t"), self.count))]
        return projected.select(*map(column, rest), *names)


def _assembled(df: DataFrame, standardizer: Standardizer) -> DataFrame:
    names = {f"_f{i}": standardizer.scaled(f) for i, f in enumerate(standardizer.means)}
    return VectorAssembler(inputCols=list(names), outputCol="_v").transform(df.withColumns(names)).drop(*names)


def reduce_components(
    df: DataFrame, features: Sequence[str], variance: float = 0.9, scale: bool = True
) -> DataFrame:
    return Components.fit(df, features, variance, scale).transform(df)


def prepared(df: DataFrame, features: Sequence[str], flavour: str, variance: float = 0.9) -> DataFrame:
    """The table as ``clean`` (untouched), ``norm`` (standardised) or ``pca`` (components)."""
    if flavour == "clean":
        return df
    if flavour == "norm":
        return standardize(df, features)
    if flavour == "pca":
        return reduce_components(df, features, variance)
    raise ValueError(f"flavour must be clean, norm or pca, not {flavour}")
