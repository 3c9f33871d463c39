from __future__ import annotations

import os

import pytest

from tessella.llm import queries as Q

D = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    df = Q.queries()[name](spark, D)
    want = con.sql(Q.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name, columns", [
    ("p1_found", ["row_id", "true_lang"]), ("p2_found", ["row_id_a", "row_id_b"]), ("p3_found", ["plan_id", "lang", "threat", "identity_hate"]), ("p4_found", ["row_id_a", "row_id_b"]),
    ("p5_found", ["row_id"]), ("p6_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id"]), ("p7_packed", None), ("p5_report", None), ("p2_groups", None), ("p8_sources", None),
])
def test_columns(spark, name, columns):
    df = Q.queries()[name](spark, D)
    assert columns is None or df.columns == columns
    assert df.count() > 0


@pytest.mark.parametrize("rows", [0, 4])
def test_queries_on_empty_and_null_tables(spark, tmp_path, rows):
    """Every query over tables without rows, and over rows of nothing but keys."""
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    keys = {"row_id", "doc_id", "plan_id", "spec_id", "tokenizer"}
    for f in ("split", "documents", "target_mix", "pack_spec"):
        t = pq.read_table(f"{D}/{f}.parquet").slice(0, rows)
        pq.write_table(pa.table([t[c.name] if c.name in keys else pa.nulls(t.num_rows, c.type) for c in t.schema], schema=t.schema), tmp_path / f"{f}.parquet")
    per_row = {"p1_segments", "p2_groups", "p4_normalised", "p4_classes", "p6_ids"}
    for name, run in Q.queries().items():
        got = run(spark, str(tmp_path)).collect()
        if name in per_row:
            assert len(got) == rows, name
        elif name.endswith("_found") and name != "p3_found":
            assert got == [], name
