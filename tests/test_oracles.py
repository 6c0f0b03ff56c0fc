"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from trawl import catalog

DATA = os.environ.get("TRAWL_TEST_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    made = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in made.description]
    place = {c: i for i, c in enumerate(columns)}
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(normal(r[place[c]]) for c in sorted(columns)) for r in made.fetchall()), key=repr)
    assert sorted((tuple(normal(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
