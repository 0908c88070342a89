"""Bounded searches over texts against brute force, and how much they encode."""

import numpy as np
from lodeseek.operators import blocks as B
from lodeseek.operators import encode as E
from lodeseek.operators import passages as W


class Counting(E.DigestEncoder):
    """Adds up the tokens that it encodes; some scale makes vectors longer than one."""

    def __init__(self, total, scale=1.0):
        self.total, self.scale = total, scale

    def vectors(self, tokens):
        self.total.add(len(tokens))
        return super().vectors(tokens) * self.scale


def _texts(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 4000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _brute(rows, queries, scale):
    model, asked = E.DigestEncoder(), {}
    for r in queries.collect():
        asked.setdefault(r["query_id"], []).append(r["qvec"])
    docs = {i: model.vectors(["[D]", *t.split()]) * scale for i, t in rows}
    return {q: sorted((-round(float((d @ np.array(v).T).max(axis=0).sum()), 6), i) for i, d in docs.items()) for q, v in asked.items()}


def test_search_encodes_once_and_equals_brute_force(spark):
    rows, docs = _texts(spark)
    queries = E.encode_queries(spark.createDataFrame([(i, rows[7 * i][1]) for i in range(20)] + [(99, rows[0][1])], "query_id long, text string"), E.DigestEncoder())
    for scale in (1.0, 3.0):
        total = spark.sparkContext.accumulator(0)
        found = W.search_windows(W.encode_windows(docs, Counting(total, scale)), queries, 5).collect()
        assert total.value == sum(len({"[D]", *t.split()}) for _, t in rows)
        want = _brute(rows, queries, scale)
        for q, best in want.items():
            assert sorted((r["rank"], r["doc_id"]) for r in found if r["query_id"] == q) == [(i, d) for i, (_, d) in enumerate(best[:5], 1)]


def test_holding_equals_brute_force(spark, monkeypatch):
    rows, docs = _texts(spark)
    queries = E.encode_queries(spark.createDataFrame([(i, rows[7 * i][1]) for i in range(20)], "query_id long, text string"), E.DigestEncoder()).where("q_tok > 0")
    sizes = {r["query_id"]: r["count"] for r in queries.groupBy("query_id").count().collect()}
    want = {(q, d) for q, best in _brute(rows, queries, 1.0).items() for s, d in best if -s >= 0.9999 * sizes[q]}
    windows = W.encode_windows(docs, E.DigestEncoder())
    assert {tuple(r) for r in W.holding(windows, queries).collect()} == want
    monkeypatch.setattr(B, "BROADCAST", 1)  # the way of queries that may not go to all tasks
    assert {tuple(r) for r in W.holding(windows, queries).collect()} == want


def test_containing_by_automaton_equals_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (4, "xx ab c d e f gh"), (None, "a b")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "b c d e f g"), (2, "b c"), (3, ""), (4, None), (5, "b c d e f g"), (6, "a b c d")], "query_id long, passage string")
    want = {(q, d) for q, p in [(1, "b c d e f g"), (2, "b c"), (3, ""), (5, "b c d e f g"), (6, "a b c d")] for d, t in [(1, "a b c d e f g h"), (3, ""), (4, "xx ab c d e f gh")] if p in t}
    assert {tuple(r) for r in W.containing(docs, passages).collect()} == want
    assert {tuple(r) for r in W._by_words(docs.where("doc_id is not null and text is not null"), passages.where("passage is not null")).collect()} == want
