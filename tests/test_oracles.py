"""Each query of the library against its SQL on the driver's smallest tables."""

import glob
import os

import pytest
from cytofold.plans import queries

AT = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{AT}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or str(v) == "<NA>" or v != v:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0) if v != int(v) else str(int(v))
    return str(v)


def table(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, db, name):
    assert table(queries.QUERIES[name](spark, AT).toPandas()) == table(db.sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, AT).count() >= 0
