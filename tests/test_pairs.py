"""All pairs of rows: blocks go to the tasks once, rows are rounded where they are made, and few files make many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import blocks as B
from lodeseek.operators import quantize as Z
from lodeseek.operators import scoring as S
from lodeseek.operators import search as Q

DIM = 8


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, DIM))
    tokens = spark.createDataFrame([(i, i // 5, v.tolist()) for i, v in enumerate(x)], "token_id long, doc_id long, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(i // 2, i % 2, v.tolist()) for i, v in enumerate(x[:20])], "query_id long, q_tok int, qvec array<double>")
    centroids = spark.createDataFrame([(3 * i + 1, v.tolist()) for i, v in enumerate(x[::30])], "cluster_id int, cvec array<double>")
    return x, tokens, queries, centroids


def test_rounded_goes_away_from_zero():
    x = np.array([0.0078125, -0.0078125, 2.5e-7, -2.5e-7, 1e300, np.inf, -3e10])
    assert B.rounded(x, 6).tolist() == [0.007813, -0.007813, 0.0, 0.0, 1e300, np.inf, -3e10]
    assert np.isnan(B.rounded(np.array([np.nan, 1.0]), 6)[0]) and not np.signbit(B.rounded(np.array([-1e-9]), 6))[0]


@pytest.mark.parametrize("most", [B.BROADCAST, 0])
def test_all_pairs_rounded_in_many_tasks(spark, table, monkeypatch, most):
    x, tokens, queries, _ = table
    monkeypatch.setattr(B, "BROADCAST", most)
    rows = S.similarities(tokens, queries, ("query_id", "q_tok", "token_id", "s"), 6)
    got = {(r["query_id"], r["q_tok"], r["token_id"]): r["s"] for r in rows.collect()}
    want = np.round(x[:20] @ x.T, 6)
    assert len(got) == want.size and all(got[q // 2, q % 2, t] == pytest.approx(want[q, t], abs=1.1e-6) for q in range(20) for t in range(300))
    if most:
        assert rows.rdd.getNumPartitions() >= 16 and "Join" not in rows._jdf.queryExecution().toString()


def test_centroid_terms_without_a_join_of_rows(spark, table):
    x, tokens, queries, centroids = table
    assigned = Z.assign_nearest(tokens, centroids)
    rows = Z.centroid_scores(assigned, queries, centroids, digits=6)
    assert "Join" not in rows._jdf.queryExecution().toString()
    terms = Q.centroid_sim(queries, centroids)
    want = {(r["query_id"], r["q_tok"], r["token_id"]): r["s"] for r in assigned.join(terms, "cluster_id").collect()}
    got = {(r["query_id"], r["q_tok"], r["token_id"]): r["s"] for r in rows.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_residual_search_over_all_clusters_by_blocks(spark, table):
    x, tokens, queries, centroids = table
    assigned = Z.assign_nearest(tokens, centroids)
    books = Z.seed_codebooks(Z.residuals(assigned, centroids), F.when(F.col("token_id") < 16, F.col("token_id")), 4, DIM)
    codes = Z.encode_codes(assigned, books, centroids)
    found = Q.search_residual_pq(codes, queries, books, centroids, k=7)
    every = Q.search_residual_pq(codes, queries, books, centroids, centroids.count(), k=7)  # all clusters too, by shards
    shown = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())
    assert shown(found) == shown(every) and len(shown(found)) == 70
    assert "cluster_id" in codes.columns and codes.where("cluster_id is null").isEmpty()


def test_exact_search_copies_no_pair_of_blocks_into_joined_rows(spark, table):
    _, tokens, queries, _ = table
    found = Q.search_bruteforce(tokens, queries, 3)
    assert "Join" not in found._jdf.queryExecution().toString() and found.count() == 30


def test_blocks_are_packed_where_they_are_used(spark, table):
    """One Python worker for a task: between packing and scoring, blocks would be sent in batches that grow with the table."""
    _, tokens, queries, centroids = table
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(S.maxsim_blocks(tokens, queries, 3)).count("MapInArrow") == 1
    assigned = Z.assign_nearest(tokens, centroids)
    swept = Q.sweep_nprobe(assigned, centroids, queries, [1, 2], 3)
    assert plan(swept).count("MapInArrow") == plan(assigned).count("MapInArrow") + 1
    packed = S.packed_documents(tokens, DIM)
    shown = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert shown(S.packed_scores(packed, queries)) == shown(S.packed_scores(packed.where("true").repartition(3), queries))
