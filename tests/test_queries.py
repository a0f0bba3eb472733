"""Every registered query of the library against its SQL on the smallest input."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from trailmill.plans import registry  # noqa: E402
import trailmill.plans  # noqa: E402, F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(columns).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=repr)
    assert got == want
