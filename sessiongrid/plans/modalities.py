"""Every modality subset in every flavour from one fit: one Gram matrix holds the moments of all of them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sessiongrid.catalog import GROUPS, NON_FEATURES, feature_names, select_modalities
from sessiongrid.operators.clean import fill_nonfinite
from sessiongrid.operators.ordered import column
from sessiongrid.operators.scaling import Standardizer

FLAVOURS = ("clean", "norm", "pca")
#: rows whose means are taken off before products are summed, so that digits are not lost
OFFSET_ROWS = 1000


def _matrix(batch: pa.RecordBatch, first: int, width: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)]) if batch.num_rows else np.empty((0, width))


@dataclass(frozen=True)
class Gram:
    """Number of rows, means and covariances (by the number of rows) of a list of features."""

    features: tuple[str, ...]
    rows: int
    means: np.ndarray
    covariance: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Gram:
        """One scan: every task sums products of its rows; sums of d x d numbers a task are shuffled, d x d reach the driver.

        Features must not be null (see ``fill_nonfinite``).
        """
        names, width = list(features), len(features)
        rows = df.select(*[column(f).cast("double").alias(f"f{i}") for i, f in enumerate(names)])
        head = rows.limit(OFFSET_ROWS).agg(*[F.avg(f"f{i}") for i in range(width)]).first()
        offset = np.array([v or 0.0 for v in head])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width + 1, width + 1))
            for batch in batches:
                ones = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch, 0, width) - offset])
                total += ones.T @ ones
            i, j = np.triu_indices(width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

        found = rows.mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
        whole = np.zeros((width + 1, width + 1))
        i, j, s = (found.column(c).to_numpy() for c in ("i", "j", "s"))
        whole[i, j] = whole[j, i] = s
        n = int(whole[0, 0])
        if not n:
            raise ValueError("cannot fit an empty table")
        shift = whole[0, 1:] / n
        return cls(tuple(names), n, offset + shift, whole[1:, 1:] / n - np.outer(shift, shift))

    def standardizer(self, features: Sequence[str]) -> Standardizer:
        at = [self.features.index(f) for f in features]
        spread = np.sqrt(np.maximum(np.diag(self.covariance)[at], 0.0))
        flat = spread <= 1e-12 * np.maximum(1.0, np.abs(self.means[at]))
        return Standardizer(dict(zip(features, self.means[at].tolist())), dict(zip(features, np.where(flat, 0.0, spread).tolist())))

    def components(self, features: Sequence[str], variance: float = 0.9, scale: bool = True) -> SubsetComponents:
        """Components of a subset from its part of the matrix: the fewest beyond ``variance``, largest first.

        The first of a component's largest loadings is positive. A constant feature loads on nothing.
        """
        at = [self.features.index(f) for f in features]
        covariance = self.covariance[np.ix_(at, at)]
        standard = self.standardizer(features)
        spread = np.array([standard.deviations[f] for f in features])
        divisor = np.where(spread > 0, spread, 1.0) if scale else np.ones(len(at))
        covariance = np.where(np.outer(spread, spread) > 0, covariance, 0.0) / np.outer(divisor, divisor)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        total = values.sum()
        count = min(int(np.searchsorted(np.cumsum(values) / total, variance, side="right")) + 1, len(at)) if total else 1
        size = np.abs(vectors)
        first = (size >= size.max(axis=0) - 1e-9).argmax(axis=0)
        vectors = vectors * np.sign(vectors[first, np.arange(len(at))])
        return SubsetComponents(tuple(features), self.means[at], divisor, vectors[:, :count], values[:count], total)


@dataclass(frozen=True)
class SubsetComponents:
    features: tuple[str, ...]
    means: np.ndarray
    divisor: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    total: float

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Features replaced by ``pc1…pck``, by one product of matrices a batch; other columns stay."""
        rest = [c for c in df.columns if c not in self.features]
        names = [f"{prefix}{i + 1}" for i in range(self.loadings.shape[1])]
        schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, T.DoubleType()) for n in names])
        turn, means, out, width, first = self.loadings / self.divisor[:, None], self.means, to_arrow_schema(schema), len(self.features), len(rest)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = (_matrix(batch, first, width) - means) @ turn
                columns = [batch.column(i) for i in range(first)] + [pa.array(np.ascontiguousarray(c)) for c in made.T]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

        return df.select(*map(column, rest), *[column(f).cast("double") for f in self.features]).mapInArrow(project, schema)


def modality_tables(
    frames: DataFrame, combinations: Sequence[str], flavours: Sequence[str] = FLAVOURS, variance: float = 0.9,
    groups: Mapping[str, Sequence[str]] = GROUPS, keys: Sequence[str] = NON_FEATURES,
) -> dict[tuple[str, str], DataFrame]:
    """Each combination in each flavour, keys once; all are fitted by one scan of the frames.

    Missing and infinite features count as 0, in the fit and in the tables.
    """
    unknown = set(flavours) - set(FLAVOURS)
    if unknown:
        raise ValueError(f"flavour must be clean, norm or pca, not {sorted(unknown)}")
    chosen = {c: fill_nonfinite(select_modalities(frames, c, None, groups, keys)) for c in combinations}
    names = {c: feature_names(df, keys) for c, df in chosen.items()}
    every = list(dict.fromkeys(f for own in names.values() for f in own))
    gram = Gram.fit(fill_nonfinite(frames.select(*map(column, every))), every) if set(flavours) != {"clean"} else None
    tables = {}
    for combination, df in chosen.items():
        for flavour in flavours:
            if flavour == "norm":
                tables[combination, flavour] = gram.standardizer(names[combination]).transform(df)
            elif flavour == "pca":
                tables[combination, flavour] = gram.components(names[combination], variance).transform(df)
            else:
                tables[combination, flavour] = df
    return tables


def write_modality_tables(tables: Mapping[tuple[str, str], DataFrame], path: str, mode: str = "error") -> None:
    """One folder ``combination=…/flavour=…`` a table under ``path``, each with its own columns."""
    for (combination, flavour), df in tables.items():
        df.write.mode(mode).parquet(f"{path}/combination={combination}/flavour={flavour}")
