"""Small tables with every awkward case."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_fixtures import SHAPE, prose  # noqa: E402


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, **extra):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in ((r if len(r) == 3 else (*r, "web")) for r in rows)]
        df = spark.createDataFrame(full, SHAPE)
        for name, value in extra.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.expr(value))
        return df

    return make


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty, marks only, very long, repeated rows, one id twice, many scripts."""
    long = prose(99, 30_000)
    return [(None, prose(1, 40)), (1, None), (2, ""), (3, " .,;!\n\n"), (4, long), (5, prose(5, 60)), (5, prose(5, 60)), (6, prose(6, 60)), (6, prose(7, 60)), (7, "één Ünïcode 漢字かな текст 😀 " + prose(8, 30)), (None, None), (8, "one"), (9, "same words here again"), (10, "same words here again"), (11, long)]
