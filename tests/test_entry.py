"""The driver's contract, and every core query against its SQL on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")


def cell(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(o) > 60 and {"p1_found", "p4_found", "p5_found"} <= set(q)
    df = e.entry(spark)
    assert df.columns and df.count() > 0


def test_core_queries_equal_their_sql(spark, sf, sql):
    from __spark_entry__ import _modules

    wrong = []
    for m in _modules():
        if ".llm" in m.__name__:
            continue
        for name, f in m.QUERIES.items():
            if name not in m.SQL:
                continue
            df = f(spark, sf)
            cols = sorted(df.columns)
            got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
            rel = sql.sql(m.SQL[name])
            at = [rel.columns.index(c) for c in cols]
            if sorted(rel.columns) != cols or sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall()) != got:
                wrong.append(name)
    assert not wrong
