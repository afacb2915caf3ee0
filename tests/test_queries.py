"""Every query against its SQL, in DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from loamline.plans import registry

SQL = registry.oracle_sql()
#: Queries without SQL, held against plain Python elsewhere.
BRUTE = {"r14_communities", "r14_modularity", "r01_chunks"}
#: Queries whose answer over the smallest tables is that there is none.
EMPTY: set[str] = set()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    # A query that returns nothing shows nothing.
    assert got or name in EMPTY
    if name not in SQL:
        assert name in BRUTE
        return
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0
