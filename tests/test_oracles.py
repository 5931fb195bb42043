"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from dialoom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return x


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    out = registry.QUERIES[name](spark, sf_dir)
    names = sorted(out.columns)
    got = [tuple(plain(r[c]) for c in names) for r in out.collect()]
    if name not in registry.ORACLES:
        return
    want = duck.sql(registry.ORACLES[name])
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert ordered(got) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])
