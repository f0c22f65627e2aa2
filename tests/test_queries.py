"""Every registered query with SQL gives what DuckDB gives, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from marginalia.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, small, duck, name):
    df = own.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in own.ORACLE_SQL:
        assert got
        return
    r = duck.execute(own.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=repr)
