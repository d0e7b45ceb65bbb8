"""Every query runs on the smallest tables, and those with SQL give what it gives."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
OWN = [n for n in entry.queries() if n.startswith("q_")]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in entry.oracle_sql():
        r = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(dict(zip(names, x))[c]) for c in columns]) for x in r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cv_id", "vacancy_id", "rank"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
