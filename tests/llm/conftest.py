import sys
from pathlib import Path

import pytest

if str(Path(__file__).parent) not in sys.path:
    sys.path.insert(0, str(Path(__file__).parent))

from llm_fixtures import SF_DIR  # noqa: E402


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, one letter, a very long text, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 30_000), (6, "x" * 50_000), (7, "same text here"), (8, "same text here"), (7, "same text here"), (None, "no id"), (None, None), (9, "Ünïcode ß 漢字 🙂")]


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


