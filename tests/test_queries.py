"""Every query against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pytest

from strataframe.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 3) + 0.0 if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, int) else v


def key(row):
    return [(x is None, str(type(x)), x if x is not None else 0) for x in row]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-3 * max(1, abs(x))), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0
