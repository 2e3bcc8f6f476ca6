"""Every registered usage query equals its DuckDB SQL on the smallest tables."""

import decimal
import os

import pytest

from meterloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(row):
    return tuple(round(float(x), 6) if isinstance(x, (float, decimal.Decimal)) else x for x in row)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(plain(r[c] for c in columns)) for r in df.collect())
    r = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted(repr(plain(dict(zip(names, x, strict=True))[c] for c in columns)) for x in r.fetchall())
    assert got == want
