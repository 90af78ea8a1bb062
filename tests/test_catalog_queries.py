"""Every catalog query against its SQL on the smallest driver tables."""

import math
import os

import pytest

from lotwise.plans import catalog_queries as Q
from lotwise.plans import field_queries, record_queries  # noqa: F401 - they add to the queries

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_rows_are_those_of_the_sql(spark, db, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    found = db.execute(Q.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted([plain(r[names.index(c)]) for c in cols] for r in found.fetchall())
