"""Whole texts as windows, passages in documents, and graph search, against brute force."""

import random
from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import numpy as np

from lodeseek.operators import blocks, encode, graph, passages
from lodeseek.sources import storage


# Whole texts


class Beside(encode.DigestEncoder):
    """Says that its vectors depend on what stands beside a token, so that none may be left out."""

    pointwise = False


def test_windows_hold_every_token(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = {1: " ".join(rng.choice(words) for _ in range(2500)), 2: "alone", 3: None, 4: "", 5: " ".join(rng.choice(words) for _ in range(700))}
    docs = spark.createDataFrame([*texts.items(), (None, "no id")], "doc_id long, text string").repartition(3)
    encoder = encode.DigestEncoder()
    queries = spark.createDataFrame([(q, t, encoder.vectors([w])[0].tolist()) for q, ws in ((7, ["w1", "w5", "far"]), (8, ["alone"])) for t, w in enumerate(ws)], "query_id long, q_tok int, qvec array<double>")
    want = {}
    for d, text in texts.items():
        have = encoder.vectors(["[D]", *(text or "").split()])
        for q, ws in ((7, ["w1", "w5", "far"]), (8, ["alone"])):
            want[q, d] = round(float((encoder.vectors(ws) @ have.T).max(axis=1).sum()), 6)
    for whole in (1 << 16, 600):  # the second way the long document is stored in parts
        monkeypatch.setattr(passages, "WHOLE", whole)
        packed = passages.encode_windows(docs, Beside(), 50, 10).cache()
        once = passages.encode_windows(docs, encoder, 50, 10)
        assert {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in passages.window_scores(once, queries).collect()} == want
        assert once.count() <= packed.count()
        got = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in passages.window_scores(packed, queries).collect()}
        assert got == want
        assert packed.where("key = 1").count() == (0 if whole > 600 else 8)
        held = Counter()
        for r in packed.collect():
            ids = np.frombuffer(r["ids"], np.int64)
            assert len(ids) == len(r["data"]) // (8 * 32) and (r["key"] == 0 or len(set(ids)) == 1)
            held.update(ids.tolist())
        # Windows of 49 words and a marker, one every 40 words.
        assert held == {d: sum(min(49, n - 40 * i) + 1 for i in range(max(1, -(-(n - 49) // 40) + 1))) for d, n in ((1, 2500), (2, 1), (3, 0), (4, 0), (5, 700))}
        top = [(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in passages.search_windows(packed, queries, 2).collect()]
        ranked = [(q, i + 1, d, want[q, d]) for q in (7, 8) for i, d in enumerate(sorted(texts, key=lambda d: (-want[q, d], d))[:2])]  # noqa: B023
        assert sorted(top) == sorted(ranked)
        assert {tuple(r) for r in passages.holding(packed, queries).collect()} == {k for k, v in want.items() if v >= (3 if k[0] == 7 else 1) - 1e-3}
        packed.unpersist()
    assert passages.encode_windows(docs.where("doc_id = 99"), encoder).count() == 0


def test_stored_windows_are_the_same_blocks_in_few_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(passages, "WHOLE", 600)
    monkeypatch.setattr(blocks, "SHARED", 3000)
    rng = random.Random(5)
    docs = spark.createDataFrame([(d, " ".join(rng.choice("abcdefgh") + str(rng.randrange(200)) for _ in range(n))) for d, n in enumerate([0, 1, 3000, *[200] * 60])], "doc_id long, text string").coalesce(2)
    packed = passages.encode_windows(docs, encode.DigestEncoder(), 50, 10, single=True)
    rows = lambda df: sorted(map(tuple, df.select("key", "ids", "subs", "data").collect()))
    blocks.compacted(packed).write.parquet(str(tmp_path / "stored"), compression="zstd")
    stored = spark.read.parquet(str(tmp_path / "stored"))
    assert rows(blocks.expanded(stored)) == rows(packed) and 1 < stored.count() < packed.count()
    assert blocks.expanded(blocks.compacted(packed.where("key = 7"))).isEmpty()


def test_stored_passages_take_few_bytes(spark, monkeypatch):
    """The store was some 15 times as large as the files of the texts."""
    data = "/root/testdata/sf0.01"
    kept, real = [], storage.built
    monkeypatch.setattr(storage, "built", lambda *a, **k: (kept.append(real(*a, **k)), kept[-1])[1])
    entry.queries()["stored_passages"](spark, data).count()
    size = sum(f.stat().st_size for f in Path(kept[0].removeprefix("file:")).iterdir())
    assert size < 7 * Path(f"{data}/documents.parquet").stat().st_size


def test_stored_passages_ask_for_whole_passages(spark, tmp_path):
    """A document with the first 31 words of a passage of 3,040 does not hold it, nor does one that lacks only the last; a short passage is as before."""
    long = [f"p{i}" for i in range(3040)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:31])), (3, " ".join(long[:-1])), (4, "short one"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(long)), (8, "one short"), (9, "p1 p2 far")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {tuple(r) for r in entry.queries()["stored_passages"](spark, str(tmp_path)).collect()}
    sql = entry.oracle_sql()["stored_passages"]
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert found == set(duckdb.sql(sql).fetchall()) == {(7, 1), (8, 4)}


def test_containing(spark):
    docs = [(1, "a b c d e f g h i j"), (2, "xa b c d e f gx"), (3, "a b c d  e f g"), (4, None), (5, ""), (6, "b c"), (1, "again b c")]
    asked = [(1, "a b c d e f g"), (2, "b c"), (3, "b c d e f"), (4, None), (5, "a b c"), (6, "q"), (7, "b c")]
    got = passages.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, passage string"))
    assert {tuple(r) for r in got.collect()} == {(q, d) for q, p in asked for d, t in docs if p is not None and t is not None and p in t}


# Graphs


def test_graph_recall_grows_with_the_beam(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24)) * 0.5 + rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame([*rows, (None, rows[0][1]), (9000, None), (9001, [None] * 24)], "doc_id long, vec array<double>").repartition(4)
    centroids = spark.createDataFrame([(0, x[0].tolist()), (1, x[1].tolist())], "cluster_id int, cvec array<double>")
    queries = spark.createDataFrame(rows[::50], "query_id long, qvec array<double>")
    graph.write_graph(graph.build_graph(vectors, centroids, shard=800, links=8, candidates=40), centroids, str(tmp_path / "graph"))
    shards, centroids = graph.read_graph(spark, str(tmp_path / "graph"))
    sizes = [r["n"] for r in shards.collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 1600 and len(sizes) >= 4  # a hot cluster is cut
    found = graph.search_graph(shards, centroids, queries, [4, 8, 32, 128], 2)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -2
    exact = {50 * i: set(np.argsort(-r)[:10].tolist()) for i, r in enumerate(s)}
    hits = Counter()
    for r in found.collect():
        assert r["doc_id"] != r["query_id"]
        hits[r["ef"]] += r["doc_id"] in exact[r["query_id"]]
    recall = [hits[e] / 600 for e in (4, 8, 32, 128)]
    assert recall == sorted(recall) and recall[0] < recall[-1] and recall[2] >= 0.9 and recall[3] >= 0.97
    assert graph.search_graph(graph.build_graph(vectors.where("doc_id < 0"), centroids), centroids, queries).count() == 0
    tiny = graph.build_graph(vectors.where("doc_id < 3"), centroids)
    assert graph.search_graph(tiny, centroids, queries.where("query_id = 0"), 16, 2).count() == 2
