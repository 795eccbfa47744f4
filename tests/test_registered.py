"""Every registered query against its SQL twin on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from firmweave.plans import catalog
from firmweave.plans.adapters import TABLES

SMALL = os.environ.get("FIRMWEAVE_TEST_DIR", entry_point.SMALLEST)
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
QUERIES, TWINS = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    done = duck.execute(TWINS[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in done.fetchall())
    assert got == want
