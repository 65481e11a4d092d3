"""Every query with SQL gives DuckDB's rows; the others give rows."""

import math

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    found = duck.execute(ORACLES[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == names
    assert ours == sorted((tuple(plain(r[theirs.index(c)]) for c in names) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1
