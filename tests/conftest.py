import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from roamspark.session import local_session

    s = local_session("4", "tests", {"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Whether a query and its SQL have the same rows and columns."""

    def frame(df):
        df = df[sorted(df.columns)]
        return df.round(6).astype(str).sort_values(list(df.columns)).reset_index(drop=True)

    def check(query, sql):
        a, b = frame(query(spark, SMALL).toPandas()), frame(duck.sql(sql).df())
        assert list(a.columns) == list(b.columns)
        assert a.equals(b), (a.head(), b.head())

    return check
