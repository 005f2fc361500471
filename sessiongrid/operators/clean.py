"""Column edits, value repair and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.catalog import numeric_names
from sessiongrid.operators.ordered import column


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c.cast("double")) == float("inf"), F.lit(False))


def trimmed_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def add_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns first, the others in their old order."""
    rest = [c for c in df.columns if c not in first]
    return df.select(*[column(c) for c in [*first, *rest]])


def audit_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts of missing (null or NaN) and infinite values, in one pass."""
    names = list(columns or numeric_names(df))
    counts = [
        F.struct(
            F.lit(name).alias("column"),
            F.count_if(is_missing(column(name))).alias("n_missing"),
            F.count_if(is_infinite(column(name))).alias("n_infinite"),
        )
        for name in names
    ]
    return df.agg(F.array(*counts).alias("_counts")).select(F.inline("_counts"))


def fill_nonfinite(df: DataFrame, columns: Sequence[str] | None = None, value: float = 0.0) -> DataFrame:
    """Null, NaN and infinities to ``value``."""
    names = list(columns or numeric_names(df))
    repaired = {
        n: F.when(is_missing(column(n)) | is_infinite(column(n)), F.lit(value)).otherwise(column(n)) for n in names
    }
    return df.withColumns(repaired)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts to doubles, null where the text is no number."""
    return df.withColumns({name: F.trim(column(name)).try_cast("double") for name in columns})


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def merge_class(df: DataFrame, label: str, old: object, new: object) -> DataFrame:
    return df.withColumn(label, F.when(column(label) == F.lit(old), F.lit(new)).otherwise(column(label)))


def exclude_classes(df: DataFrame, label: str, classes: Sequence[object]) -> DataFrame:
    return df.where(~column(label).isin(*classes))


def blank_missing_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(column(name).cast("string"), F.lit("")) for name in columns})
