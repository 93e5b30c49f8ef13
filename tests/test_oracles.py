"""Every query with SQL gives DuckDB's rows on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from kontra.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "%.7g" % (v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want
