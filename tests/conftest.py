import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("FOLIOSCOPE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import local_session

    session = local_session(4, 4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


def compare(spark_df, con, sql):
    rows = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(spark_df.columns)

    def text(v):
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    keys = sorted(names)
    mine = sorted(tuple(text(r[spark_df.columns.index(k)]) for k in keys) for r in rows)
    theirs = sorted(tuple(text(r[names.index(k)]) for k in keys) for r in cursor.fetchall())
    assert mine == theirs
