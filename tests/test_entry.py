"""Every query of the graph itself against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__
from graftwork.plans import data_quality, graph_queries

DATA = "/root/testdata/sf0.001"
NAMES = [n for m in (graph_queries, data_quality) for n in m.QUERIES if n in m.SQL]


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, base, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = base.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text_queries_are_optional(monkeypatch):
    monkeypatch.setitem(sys.modules, "graftwork.llm.queries", None)
    names = set(__spark_entry__.queries())
    assert {"p1_found", "p5_found", "edge_admission"} <= names and not names & {"p2_found", "p8_found"}
    assert set(__spark_entry__.oracle_sql()) <= names
