"""Every registered query of the library against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

from siftwell.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in registry.oracle_sql():
        run = duck.execute(registry.oracle_sql()[name])
        there = [x[0] for x in run.description]
        assert sorted(there) == names
        assert got == sorted(tuple(plain(r[there.index(c)]) for c in names) for r in run.fetchall())


def test_entry(spark):
    assert registry.entry(spark, DATA).count() > 0
