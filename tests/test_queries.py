"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodeseek.operators import evaluate as M
from lodeseek.operators import search as Q
from lodeseek.plans import fixtures as X
from lodeseek.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "benchmark", "labels", "events", "pages", "conversations", "orders", "customer")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def shown(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([shown(r[c]) for c in columns] for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted([shown(r[names.index(c)]) for c in columns] for r in cursor.fetchall())
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count() > 0


def test_evaluate_reads_as_many_results_as_its_recall(spark):
    """With all clusters probed the recall is that of the exact search's first hundred, not of its first ten."""
    exact = M.mean_metrics(M.query_metrics(Q.search_bruteforce(X.tokens(spark, DATA), X.queries(spark, DATA), 100), X.labels(spark, DATA))).first()
    rows = {r["nprobe"]: r for r in QUERIES["evaluate"](spark, DATA).collect()}
    ten = M.mean_metrics(M.query_metrics(Q.search_bruteforce(X.tokens(spark, DATA), X.queries(spark, DATA), 10), X.labels(spark, DATA))).first()
    assert rows[16]["recall"] > ten["recall"] and abs(rows[16]["recall"] - exact["recall"]) < 0.05 and rows[16]["n_queries"] == exact["n_queries"]


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
