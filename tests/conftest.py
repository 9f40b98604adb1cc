import os

import pytest

from arbora.session import drop_scratch, local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, partitions=4)
    yield s
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d


@pytest.fixture(scope="session")
def compare(spark, sf):
    """Runs a query and its SQL on the same tables and compares all rows."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")

    def run(f, sql):
        df = f(spark, sf)
        cols = sorted(df.columns)
        got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(str(tuple(x[i] for i in at)) for x in rel.fetchall())

    return run
