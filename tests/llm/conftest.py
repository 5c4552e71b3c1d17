import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from cases import edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    """The edge cases with extra columns whose names clash with those the operators add."""
    rows = [(*r, "x", 7, 0.5, "y", True) for r in edge_rows()]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, "
        "Score string, n_tokens int, SIZE double, __maybe string, kept boolean",
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
