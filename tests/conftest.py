import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom.session import session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(data)):
        path = os.path.join(data, file)
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float) and value != value:
        return None
    return value


def normal(frame):
    """Rows of a pandas frame, columns by name, as sorted texts."""
    import pandas as pd

    columns = sorted(frame.columns)
    return sorted(repr(tuple(None if v is None or v is pd.NaT or v is pd.NA else plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def compare(spark, data, duck):
    """Hold a query against its SQL: the same columns and the same rows."""

    def run(query, sql):
        got, want = query(spark, data).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)

    return run
