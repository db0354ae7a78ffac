"""Every registered core query runs, and those with SQL give what the SQL gives."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from stratafin.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]
    if name in ORACLES:
        rel = duck.execute(ORACLES[name])
        names = [d[0] for d in rel.description]
        want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
        assert sorted(names) == cols and Counter(got) == Counter(want)
    else:
        assert got
