"""Arrays of numbers: probabilities, one-hot codes, padding and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_class(probability: Column, cut: float = 0.5) -> Column:
    return F.when(probability > cut, 1).otherwise(0)


def argmax(vector: Column) -> Column:
    """Zero-based place of the greatest entry, the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def mean_vector(vectors: Sequence[Column]) -> Column:
    """Element-wise mean of vectors of one length."""
    total = vectors[0]
    for vector in vectors[1:]:
        total = F.zip_with(total, vector, lambda a, b: a + b)
    return F.transform(total, lambda x: x / F.lit(float(len(vectors))))


def one_hot(label: Column, classes: int) -> Column:
    places = F.sequence(F.lit(0), F.lit(classes - 1))
    return F.transform(places, lambda place: F.when(place == label, 1.0).otherwise(0.0))


def fit_length(vector: Column, length: int, fill: float = 0.0) -> Column:
    """Cut or pad at the end to a fixed length."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(fill), length)), 1, length)


def affine(vector: Column, mean: float, half_width: float) -> Column:
    """``(x - mean) / (2 · half_width)`` for every entry."""
    return F.transform(vector, lambda x: (x - F.lit(mean)) / F.lit(2.0 * half_width))


def to_columns(vector: Column, length: int, prefix: str = "f_") -> list[Column]:
    return [F.get(vector, i).alias(f"{prefix}{i}") for i in range(length)]


def from_columns(columns: Sequence[Column]) -> Column:
    return F.array(*columns)
