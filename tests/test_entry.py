from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


CORE = sorted(k for k in entry.oracle_sql() if not k.startswith("p") or not k[1:2].isdigit())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    a = sorted(repr(tuple(map(norm, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    b = sorted(repr(tuple(norm(r[i]) for i in at)) for r in want.fetchall())
    assert a == b
