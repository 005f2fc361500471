"""Label lists, names in paths, and small text formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The annotation vocabulary and its categories.
ANNOTATION_LABELS = (
    "repeated prompt",
    "more specific/longer prompt",
    "swapping terms in prompt",
    "simpler prompt",
    "slower",
    "demanding tone",
    "interrogative tone",
    "filler words",
    "amusement/humor",
    "confusion",
    "frustration",
    "quitting",
)
ANNOTATION_CATEGORIES = {
    "reprompting strategies": (
        "repeated prompt",
        "more specific/longer prompt",
        "swapping terms in prompt",
        "simpler prompt",
    ),
    "verbal tone or cadence": ("slower", "demanding tone", "interrogative tone", "filler words"),
    "emotion": ("amusement/humor", "confusion", "frustration"),
    "other": ("quitting",),
}
REPROMPT_LABELS = ANNOTATION_CATEGORIES["reprompting strategies"]


def texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_labels(text: Column, vocabulary: Sequence[str] | None = None, separator: str = ",") -> Column:
    """``'"a, b"'`` to ``["a", "b"]``: quotes off, trimmed, and only vocabulary words if given."""
    bare = F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit(""))
    labels = F.transform(F.split(bare, separator), lambda label: F.trim(label))
    if vocabulary is None:
        return F.filter(labels, lambda label: label != "")
    known = texts(vocabulary)
    return F.filter(labels, lambda label: F.array_contains(known, label))


def other_bucket(labels: Column, vocabulary: Sequence[str], other: str = "other") -> Column:
    """Labels outside the vocabulary become ``other``."""
    known = texts(vocabulary)
    return F.transform(labels, lambda label: F.when(F.array_contains(known, label), label).otherwise(F.lit(other)))


def category_of(label: Column, categories: Mapping[str, Sequence[str]]) -> Column:
    """Category whose label list holds the label, null if none does."""
    pairs = [F.lit(part) for category, labels in categories.items() for part in _spread(labels, category)]
    return F.try_element_at(F.create_map(*pairs), label)


def _spread(labels: Sequence[str], category: str) -> list[str]:
    return [part for label in labels for part in (label, category)]


def file_stem(path: Column) -> Column:
    """Name between the last slash (either kind) and the last dot after it."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def name_token(path: Column, position: int, separator: str = "_") -> Column:
    """Token of a file name, counted from 0, null if it has fewer."""
    return F.get(F.split(file_stem(path), separator), position)


def frame_of_name(path: Column) -> Column:
    """Frame number: the last four characters of the second ``_`` token of the file name."""
    return F.right(name_token(path, 1), F.lit(4)).try_cast("int")


def pair_session_id(number: Column) -> Column:
    """Even n belongs to session ``n ‖ n+1 ‖ _0``, odd n to ``n-1 ‖ n ‖ _1``."""
    odd = F.pmod(number, F.lit(2))
    low = number - odd
    return F.concat(low.cast("string"), (low + 1).cast("string"), F.lit("_"), odd.cast("string"))


def after_last_colon(text: Column) -> Column:
    return F.substring_index(text, ":", -1)


def array_literal(text: Column) -> Column:
    """``"[1.5, 2]"`` to an array of doubles."""
    return F.from_json(text, "array<double>")


# Fixed value: the form of a metric line, with sign and exponent.
METRIC_LINE = r"^(\w+): ([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def metric_name(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, METRIC_LINE, 1), F.lit(""))


def metric_value(line: Column) -> Column:
    return F.regexp_extract(line, METRIC_LINE, 2).try_cast("double")


def stars(p: Column) -> Column:
    """Significance marks of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("N.S.")
