import math

import pytest

from specmill import queries as Q

duckdb = pytest.importorskip("duckdb")


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(small):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_sql(spark, small, con, name):
    df = Q.queries()[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = Q.oracle_sql().get(name)
    if sql:
        rel = con.sql(sql)
        assert sorted(rel.columns) == names
        at = [list(rel.columns).index(c) for c in names]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
