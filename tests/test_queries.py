"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import pytest

from tablebridge import plans
from tests.literal_cases import CASES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "normalize"):
        return str(v.normalize()) if v else "0"
    return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    rel = duck.execute(plans.SQL[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(plain(v) for v in r) for r in rel.fetchall())
    df = plans.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == want


@pytest.mark.parametrize("name", sorted(CASES))
def test_fixed_rows(spark, name):
    import duckdb

    run, sql = CASES[name]
    rel = duckdb.connect().execute(sql)
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(plain(v) for v in r) for r in rel.fetchall())
    df = run(spark, SF)
    assert sorted(df.columns) == sorted(cols) and sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
