"""The queries on texts against their SQL, on the smallest tables, and what they give where there is no SQL."""

import os

import duckdb
import pytest

from graftwork.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_scores_and_rates(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    scores, rates = QUERIES["p8_scores"](spark, DATA).collect(), QUERIES["p8_rates"](spark, DATA).collect()
    assert len({r.doc_id for r in scores}) == len(scores) == n
    assert sum(r.n_documents for r in rates) == n
    assert sum(r.n_found for r in rates) == QUERIES["p8_found"](spark, DATA).count()
