"""Frame table to significant features and starred tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sessiongrid.catalog import NON_FEATURES, keep_features
from sessiongrid.operators import hypothesis as h
from sessiongrid.operators.clean import exclude_classes
from sessiongrid.operators.rank import cut_at_drop, ranked_drops


def welch_features(df: DataFrame, features: Sequence[str], label: str = "binary_label", alpha: float = 0.05) -> DataFrame:
    return h.significant(h.welch_t(df, features, label), len(features), alpha)


def kruskal_table(
    df: DataFrame, features: Sequence[str], label: str = "multiclass_label", drop: Sequence = (0, 4, 5), alpha: float = 0.05
) -> DataFrame:
    """Kruskal-Wallis with Dunn's pairs on the classes left after ``drop``, without presence columns."""
    kept = exclude_classes(df, label, drop) if drop else df
    names = [f for f in features if not f.endswith("_c")]
    classes = h.class_list(kept, label)
    sums = h.rank_sums(kept, names, label, classes)
    return h.starred_table(sums, classes, len(names), alpha)


def anova_tukey(df: DataFrame, features: Sequence[str], label: str = "multiclass_label", alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """ANOVA per feature, and Tukey's pairs for the features significant after Bonferroni."""
    classes = h.class_list(df, label)
    table = h.class_table(h.class_moments(df, features, label), classes)
    return h.anova_f(table), h.tukey_hsd(table, classes, alpha=alpha, tests=len(features))


def significant_set(df: DataFrame, results: DataFrame, non_features: Sequence[str] = NON_FEATURES) -> DataFrame:
    """The frame table cut to the features of a result table, whose length is that of the schema."""
    return keep_features(df, [r["feature"] for r in results.select("feature").collect()], non_features)


def important_set(
    df: DataFrame, importances: DataFrame, threshold: float = 0.4, non_features: Sequence[str] = NON_FEATURES
) -> DataFrame:
    """The frame table cut to the features ranked before the first big drop in importance."""
    return significant_set(df, cut_at_drop(ranked_drops(importances), threshold), non_features)
