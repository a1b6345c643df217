"""One session for all tests, and the comparison with DuckDB."""

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from meridian.plans.materialize import release, ship_package

    ship_package(session)
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of comparable values, columns by name."""

    def plain(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str([plain(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return repr(round(float(v), 6) + 0.0)
        if type(v).__name__.startswith(("int", "uint")):
            return repr(float(v)) if abs(int(v)) < 2**53 else str(int(v))
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    """Assert that two pandas frames hold the same rows under the same names."""

    def check(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
        assert sorted(ours.columns) == sorted(theirs.columns)
        a, b = rows_of(ours), rows_of(theirs)
        assert len(a) == len(b)
        assert [(x, y) for x, y in zip(a, b) if x != y][:3] == []

    return check
