"""Edge cases by hand."""

import numpy as np
import pytest
import rowtier
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions import vectors as V
from lodeseek.operators import blocks, encode, evaluate, index, profile, quantize, scoring, search
from lodeseek.operators import text as C
from lodeseek.operators.lazy import Lazy, load_model
from lodeseek.sources import storage
from lodeseek.streaming import ingest


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, i // 3, [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "token_id long, doc_id long, vec array<double>")


def queries_of(spark, x, n=6):
    return spark.createDataFrame([(i // 2, i % 2, [float(v) for v in x[i]]) for i in range(n)], "query_id long, q_tok int, qvec array<double>")


def close(got, want, keys, value, digits=9):
    """Rows of both, equal in keys and nearly equal in value."""
    a, b = ({tuple(r[k] for k in keys): r[value] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) and all(abs(a[k] - b[k]) < 10**-digits for k in a)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


KEYS = ("query_id", "doc_id")


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
def test_kernels_equal_the_row_tier(spark, monkeypatch, broadcast):
    """Random vectors, ties and repeated vectors among them, 256 codewords (codes over 127), and a bound that sends nothing to all executors."""
    monkeypatch.setattr(blocks, "BROADCAST", broadcast)
    monkeypatch.setattr(blocks, "ROWS", 50)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 7)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((420, 8)).round(2)
    x[300:340] = x[100:140]
    tokens = spark.createDataFrame([(i, i // 4 % 90, [float(v) for v in r]) for i, r in enumerate(x)], "token_id long, doc_id long, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(i // 3, i % 3, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((20, 8)))], "query_id long, q_tok int, qvec array<double>")
    centroids = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate([*x[:15], x[3]])], "cluster_id int, cvec array<double>")
    books = spark.createDataFrame([(m, k, [float(v) for v in x[k, 4 * m : 4 * m + 4]]) for m in range(2) for k in range(256)], "m int, k int, cvec array<double>")
    near = quantize.assign_nearest(tokens, centroids)
    assert rows_of(near.select("token_id", "cluster_id")) == rows_of(rowtier.assign_nearest(tokens, centroids))
    coded = quantize.encode_codes(near, books)
    slow = rowtier.pq_encode(tokens, books, 2, 8)
    assert rows_of(quantize.transpose_codes(coded).select("token_id", "m", "code")) == rows_of(slow.select("token_id", "m", "k"))
    close(coded, slow.groupBy("token_id").agg(F.sqrt(F.sum("d")).alias("error")), ("token_id",), "error")
    codes = slow.join(near.select("token_id", "doc_id", "cluster_id"), "token_id")
    table = rowtier.lookup_scores(codes, queries, books, 2, 8)
    close(quantize.lookup_scores(coded, queries, books), table, ("query_id", "q_tok", "token_id"), "s")
    exact = rowtier.maxsim(rowtier.similarities(tokens, queries))
    close(scoring.maxsim_blocks(tokens, queries), exact, KEYS, "score")
    close(scoring.similarities(tokens, queries), rowtier.similarities(tokens, queries), ("query_id", "q_tok", "token_id"), "s")
    assert rows_of(search.search_bruteforce(tokens, queries, 7)) == rows_of(scoring.top_k(exact, 7))
    assert rows_of(search.search_pq(coded, queries, books, 9)) == rows_of(scoring.top_k(rowtier.maxsim(table), 9))
    probed = rowtier.probed(queries, centroids, 2)
    assert rows_of(search.probed_clusters(queries, centroids, 2)) == rows_of(probed)
    found = near.join(probed, "cluster_id").select("query_id", "token_id")
    for got, scores in ((search.search_ivf(near, centroids, queries, 2, 9), rowtier.similarities(tokens, queries)), (search.search_ivf_pq(coded, queries, books, centroids, 2, 9), table)):
        assert rows_of(got) == rows_of(scoring.top_k(rowtier.maxsim(scores.join(found, ["query_id", "token_id"])), 9))
    left = quantize.residuals(near, centroids)
    rcoded = quantize.encode_codes(near, books, centroids)
    assert rows_of(quantize.transpose_codes(rcoded).select("token_id", "m", "code")) == rows_of(rowtier.pq_encode(left, books, 2, 8).select("token_id", "m", "k"))
    rcodes = rowtier.pq_encode(left, books, 2, 8).join(near.select("token_id", "doc_id", "cluster_id"), "token_id")
    terms = rowtier.similarities(centroids.select(F.lit(0).alias("doc_id"), F.col("cluster_id").alias("token_id"), F.col("cvec").alias("vec")), queries).select("query_id", "q_tok", F.col("token_id").alias("cluster_id"), F.col("s").alias("c"))
    whole = rowtier.lookup_scores(rcodes, queries, books, 2, 8).join(near.select("token_id", "cluster_id"), "token_id").join(terms, ["query_id", "q_tok", "cluster_id"]).withColumn("s", F.col("s") + F.col("c"))
    assert rows_of(search.search_residual_pq(rcoded, queries, books, centroids, None, 9)) == rows_of(scoring.top_k(rowtier.maxsim(whole), 9))
    assert rows_of(search.search_residual_pq(rcoded, queries, books, centroids, 2, 9)) == rows_of(scoring.top_k(rowtier.maxsim(whole.join(found, ["query_id", "token_id"])), 9))
    sweep = search.sweep_nprobe(near, centroids, queries, [1, 2, 16], 9)
    assert rows_of(sweep.where("nprobe = 2").drop("nprobe")) == rows_of(search.search_ivf(near, centroids, queries, 2, 9))
    assert rows_of(sweep.where("nprobe = 16").drop("nprobe")) == rows_of(scoring.top_k(exact, 9))


def test_incomplete_vectors_and_empty_sides(spark):
    tokens = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, None), (2, 1, [1.0]), (3, 1, [None, 1.0]), (4, 1, [0.0, 1.0]), (5, None, [9.0, 9.0])], "token_id long, doc_id long, vec array<double>")
    queries = spark.createDataFrame([(5, 0, [1.0, 0.5]), (6, 0, None)], "query_id long, q_tok int, qvec array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id int, cvec array<double>")
    assert rows_of(search.search_bruteforce(tokens, queries)) == [(5, 0, 1.0, 1), (5, 1, 0.5, 2)]
    near = quantize.assign_nearest(tokens, c)
    assert rows_of(near.select("token_id", "cluster_id")) == [(0, 0), (4, 1), (5, 0)]
    assert rows_of(search.search_ivf(near, c, queries, 1)) == [(5, 0, 1.0, 1)]
    for few in (tokens.limit(0), tokens):
        for none in (queries.limit(0), queries.where("query_id = 6")):
            assert search.search_bruteforce(few, none).count() == search.search_ivf(near.join(few, "token_id", "left_semi"), c, none, 1).count() == 0
    assert search.search_bruteforce(tokens.limit(0), queries).count() == 0
    assert rows_of(blocks.project(tokens.select("token_id", "vec"), "vec", [[1.0, 2.0, 0.0], [0.0, 1.0, 1.0]])) == [(0, [1.0, 2.0, 0.0]), (1, None), (2, None), (3, None), (4, [0.0, 1.0, 1.0]), (5, [9.0, 27.0, 9.0])]


def test_stored_corpora_in_single_precision(spark, vectors, tmp_path):
    x, tokens = vectors
    q = queries_of(spark, x)
    scoring.packed_documents(tokens, 8, single=True).write.parquet(str(tmp_path / "packed"))
    stored = spark.read.parquet(str(tmp_path / "packed"))
    close(scoring.packed_scores(stored, q), scoring.maxsim_blocks(tokens, q), KEYS, "score", digits=5)
    assert "hashpartitioning(doc_id" not in search.search_packed(stored, q)._jdf.queryExecution().executedPlan().toString()


def test_search_texts(spark):
    docs = spark.createDataFrame([(1, "red green"), (2, "blue sky")], "doc_id long, text string")
    tokens = encode.encode_docs(docs)
    texts = spark.createDataFrame([(7, "sky"), (8, "green red")], "query_id long, text string")
    best = {r["query_id"]: r["doc_id"] for r in search.search_texts(tokens, texts).where("rank = 1").collect()}
    assert best == {7: 2, 8: 1}
    padded = encode.encode_queries(texts, augment=True)
    assert rows_of(search.search_texts(tokens, texts, augment=True)) == rows_of(search.search_chunked(tokens, padded))


def test_plans_join_blocks_and_not_rows(spark, vectors):
    """No nested-loop join over rows of tokens: what is paired are blocks."""
    x, tokens = vectors
    q = queries_of(spark, x)
    plan = search.search_bruteforce(tokens, q)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("NestedLoopJoin")]
    assert plan.count("NestedLoopJoin") == 1 and above.count("MapInArrow") == 1 and plan.count("MapInArrow") == 3


def test_probing_all_clusters_is_exact(spark, vectors):
    x, tokens = vectors
    q, c = queries_of(spark, x), tokens.where("token_id < 4").select(F.col("token_id").cast("int").alias("cluster_id"), F.col("vec").alias("cvec"))
    near = quantize.assign_nearest(tokens, c)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    assert key(search.search_ivf(near, c, q, 4)) == key(search.search_bruteforce(tokens, q))
    few = search.search_ivf(near, c, q, 1, k=1000)
    assert few.groupBy("query_id").count().where("count > 20").count() == 0


def test_training_lowers_the_error(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 6)) * 4
    x = np.repeat(centres, 60, axis=0) + 0.1 * rng.standard_normal((480, 6))
    tokens = spark.createDataFrame([(i, i // 5, [float(v) for v in r]) for i, r in enumerate(x[rng.permutation(480)])] + [(999, 99, None)], "token_id long, doc_id long, vec array<double>")
    trained = quantize.kmeans_train(tokens, 8)
    again = quantize.kmeans_train(tokens, 8)
    assert rows_of(trained) == rows_of(again)
    error = lambda c: scoring.distances(tokens, c).groupBy("token_id").agg(F.min("d").alias("d")).agg(F.avg("d")).first()[0]
    start = tokens.where("token_id < 8").select(F.col("token_id").cast("int").alias("cluster_id"), F.col("vec").alias("cvec"))
    assert trained.count() == 8 and error(trained) < 0.1 < error(start)
    step = quantize.lloyd_step(tokens, start)
    assert error(step) < error(start)
    assert quantize.kmeans_train(tokens.where("token_id < 3"), 8).count() == 3
    few, many = (quantize.pq_train(tokens, 2, k, 6) for k in (2, 64))
    mean = lambda b: [r[0] for r in b.groupBy("m").agg(F.first("error").alias("e")).orderBy("m").select("e").collect()]
    assert all(a > b > 0 for a, b in zip(mean(few), mean(many), strict=True))
    coded = quantize.encode_codes(tokens, many)
    assert coded.count() == 480 and coded.agg(F.avg("error")).first()[0] < quantize.encode_codes(tokens, few).agg(F.avg("error")).first()[0]


@pytest.mark.parametrize("residual", [False, True])
def test_stored_index(spark, tmp_path, residual):
    """Train, write, read, search: recall of at least 0.75 at eight probes, and neither tokens nor candidates are shuffled."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 50, axis=0) + 0.5 * rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(2000)]
    tokens = spark.createDataFrame([(i, i // 5, [float(v) for v in r]) for i, r in enumerate(x)], "token_id long, doc_id long, vec array<double>")
    queries = queries_of(spark, x + 0.02 * rng.standard_normal(x.shape), 40)
    path = str(tmp_path / "index")
    index.build_index(tokens, path, 40, 8, 64, residual)
    got = index.search_index(spark, path, queries, 8, 10)
    recall = evaluate.recall_against(got, search.search_bruteforce(tokens, queries)).agg(F.avg("recall")).first()[0]
    assert recall >= 0.75
    one = index.search_index(spark, path, queries.where("query_id = 0"), 1, 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "hashpartitioning(query_id" in plan  # only the best rows of each task move
    assert got.count() == 200 and one.count() == min(10, one.count()) > 0


def test_chunk_windows(spark):
    size, overlap = 10, 4
    lengths = [0, 1, 9, 10, 11, 15, 16, 50]
    docs = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in lengths], "doc_id long, tokens array<string>")
    got: dict = {}
    for r in C.chunk_windows(docs, size, overlap).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for n in lengths:
        want, start = [], 0
        while True:
            end = min(start + size - 1, n)
            want.append((start, end))
            if end == n:
                break
            start += size - overlap
        assert sorted(got[n]) == want
    with pytest.raises(ValueError):
        C.chunk_windows(docs, 10, 10)


def test_text(spark):
    row = spark.createDataFrame([(None, "b\nc"), ("a", None)], "title string, text string").select(T.doc_to_text(F.col("title"), F.col("text")).alias("x"), T.snippet(F.col("text")).alias("s")).collect()
    assert [r["x"] for r in row] == [". b\nc", "a."] and row[0]["s"] == "b c"
    docs = spark.createDataFrame([(3, "A"), (1, "a"), (2, "A")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in C.dedup_first(docs).collect()) == [1, 2]


def test_guards(spark, vectors):
    _, tokens = vectors
    with pytest.raises(ValueError):
        V.check_parts(64, 5)
    with pytest.raises(ValueError):
        quantize.pq_train(tokens, 2, 300, 8)
    with pytest.raises(ValueError):
        quantize.codebook_array(spark.createDataFrame([(0, 1, [1.0])], "m int, k int, cvec array<double>"))


def test_metrics(spark):
    results = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.5, 2)], "query_id long, doc_id long, score double, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 10, 1), (3, 10, 0)], "query_id long, doc_id long, relevance int")
    got = {r["query_id"]: (r["ndcg"], r["recall"]) for r in evaluate.query_metrics(results, qrels).collect()}
    ideal = 1 + 1 / np.log2(3)
    assert got.keys() == {1, 2} and abs(got[1][0] - (1 / np.log2(3)) / ideal) < 1e-12 and got[1][1] == 0.5 and got[2] == (0, 0)


def test_empty_cluster_keeps_its_centroid(spark, vectors):
    _, tokens = vectors
    c = spark.createDataFrame([(0, [0.0] * 8), (1, [99.0] * 8)], "cluster_id int, cvec array<double>")
    assert {r["cluster_id"]: r["cvec"] for r in quantize.lloyd_step(tokens, c).collect()}[1] == [99.0] * 8
    lists = {r["cluster_id"]: r["token_ids"] for r in quantize.posting_lists(quantize.assign_nearest(tokens, c), c).collect()}
    assert lists[1] == [] and lists[0] == list(range(60))


def test_storage_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red green"), (2, "blue"), (3, "")], "doc_id long, text string")
    tokens = encode.encode_docs(docs, encode.HashEncoder(8)).withColumn("token_id", F.col("doc_id") * 100 + F.col("pos"))
    c = tokens.where("pos = 0").select(F.col("doc_id").cast("int").alias("cluster_id"), F.col("vec").alias("cvec"))
    book = quantize.pq_train(tokens, 2, 2, 8)
    near = quantize.assign_nearest(tokens.select("token_id", "doc_id", "vec"), c)
    codes = quantize.encode_codes(near, book, c)
    storage.write_index(str(tmp_path / "index"), c, book, codes, m=2, dim=8)
    back = storage.read_index(spark, str(tmp_path / "index"))
    names = ["token_id", "doc_id", "cluster_id", "codes"]
    assert rows_of(back["codes"].select(names)) == rows_of(codes.select(names)) and rows_of(back["meta"]) == [("dim", 8), ("m", 2)]
    assert rows_of(back["centroids"]) == rows_of(c) and rows_of(back["codebooks"]) == rows_of(book)
    built = storage.build_if_missing(spark, str(tmp_path / "built"), lambda: docs)
    assert built.count() == 3 and storage.build_if_missing(spark, str(tmp_path / "built"), lambda: 1 / 0).count() == 3
    storage.append_history(docs.limit(1), str(tmp_path / "history"), run="x")
    storage.append_history(docs.limit(1), str(tmp_path / "history"), run="y")
    assert spark.read.json(str(tmp_path / "history")).count() == 2
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_index(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), back["centroids"], back["codebooks"], encode.HashEncoder(8))
    stream.awaitTermination(120)
    doc, pos = F.col("doc_id"), F.col("token_id") % 100
    want = codes.select((doc * (1 << 20) + pos).alias("token_id"), *names[1:])
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select(names)) == rows_of(want)


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"passages": {"passage_text": ["a b", "c"]}}\n{"passages": {"passage_text": []}}\n{"passages": {"passage_text": ["d"]}}\n')
    assert [r["text"] for r in storage.read_passages(spark, str(tmp_path / "p.json")).collect()] == ["a b", "c", "d"]
    for name, line in (("docs", '{"doc_id": "1", "title": "t", "text": "x"}'), ("queries", '{"query_id": "q", "text": "y"}'), ("qrels", '{"query_id": "q", "doc_id": "1", "relevance": 2}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(line + "\n")
    docs, queries, qrels = storage.read_benchmark(spark, str(tmp_path))
    assert rows_of(docs) == [("1", "t", "x")] and rows_of(queries) == [("q", "y")] and rows_of(qrels) == [("q", "1", 2)]
    tokens = spark.createDataFrame([(1, 0, [0.5, 1.5])], "doc_id long, pos int, vec array<double>")
    storage.write_corpus(tokens, str(tmp_path / "corpus.parquet"))
    assert rows_of(storage.read_table(spark, str(tmp_path), "corpus")) == rows_of(tokens)
    for n in (1, 2):
        storage.write_report(spark.range(1).select(F.lit(n).alias("ndcg")), str(tmp_path / "report"))
    files = list((tmp_path / "report").glob("*.json"))
    assert len(files) == 1 and files[0].read_text() == '{"ndcg":2}\n'


class Counted:
    """An encoder that counts how often it is made in a process."""

    made = 0

    def __init__(self, dim):
        type(self).made += 1
        self.dim = dim

    def vectors(self, tokens):
        return np.array([[len(t), type(self).made] for t in tokens], dtype=float).reshape(-1, self.dim)


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "aa b"), (2, ""), (3, None), (4, "w " * 300)], "doc_id long, text string")
    model = encode.HashEncoder(8)
    unit = lambda t: model.vectors([t])[0]
    got = {}
    for r in encode.encode_docs(docs, model).collect():
        got.setdefault(r["doc_id"], {})[r["pos"]] = r["vec"]
    assert got.keys() == {1, 2, 3, 4} and [len(got[i]) for i in (1, 2, 3, 4)] == [3, 1, 1, 178]
    assert all(np.allclose(got[1][i], unit(t)) for i, t in enumerate(("[D]", "aa", "b"))) and np.allclose(np.linalg.norm(got[1][1]), 1)
    single = {r["doc_id"]: r["vec"] for r in encode.encode_single(docs, model).collect()}
    both = unit("aa") + unit("b")
    assert np.allclose(single[1], both / np.linalg.norm(both)) and single[2] == single[3] == [0.0] * 8
    q = {r["q_tok"]: r["qvec"] for r in encode.encode_queries(docs.where("doc_id = 1").withColumnRenamed("doc_id", "query_id"), model, augment=True).collect()}
    assert len(q) == 30 and all(np.allclose(q[i], unit("[MASK]")) for i in range(3, 30)) and np.allclose(q[1], unit("aa"))
    plain = encode.encode_queries(docs.withColumnRenamed("doc_id", "query_id"), model).groupBy("query_id").count()
    assert dict(rows_of(plain)) == {1: 3, 2: 1, 3: 1, 4: 30}
    lazily = encode.encode_docs(docs, Lazy("test_operators:Counted", (("dim", 2),)), tokenizer=Lazy("test_operators:letters")).where("doc_id = 1").orderBy("pos").collect()
    assert [r["vec"] for r in lazily] == [[1.0, 1.0]] * 8
    assert load_model(Lazy("test_operators:Counted", (("dim", 2),))) is load_model(Lazy("test_operators:Counted", (("dim", 2),)))


def letters():
    return list


def test_tokenizer_can_be_replaced(spark):
    docs = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    assert rows_of(C.tokenized(docs)) == [(1, ["ab", "c"]), (2, None)]
    assert rows_of(C.tokenized(docs, tokenizer=list)) == [(1, ["a", "b", " ", "c"]), (2, [])]


def test_recall_counts_queries_without_results(spark):
    exact = spark.createDataFrame([(1, 10, 1), (2, 11, 1)], "query_id long, doc_id long, rank int")
    found = spark.createDataFrame([(2, 1, 10, 1), (8, 1, 10, 1), (8, 2, 11, 1)], "nprobe int, query_id long, doc_id long, rank int")
    assert rows_of(evaluate.recall_against(found.where("nprobe = 2"), exact, 1)) == [(1, 1.0), (2, 0.0)]
    assert rows_of(evaluate.recall_against(found, exact, 1, by=("nprobe",))) == [(2, 1, 1.0), (2, 2, 0.0), (8, 1, 1.0), (8, 2, 1.0)]


def test_order_statistics_and_offsets(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.integers(0, 50, 3000).tolist(), "b": rng.standard_normal(7001).tolist(), "c": [4.0]}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("a", None)], "key string, v double")
    shares = [0.0, 0.5, 0.9, 0.99, 1.0]
    want = [(k, p, float(sorted(x)[min(len(x) - 1, int(len(x) * p))])) for k, x in values.items() for p in shares]
    assert rows_of(C.order_statistic(rows, "v", shares, ["key"])) == sorted(want)
    ids = sorted({int(i) for i in rng.integers(-(1 << 60), 1 << 60, 3000)})
    got = dict(rows_of(C.prefix_offsets(spark.createDataFrame([(i, 1 + k % 7) for k, i in enumerate(ids)], "o long, n int").repartition(3), "o", "n", spans=16)))
    at = 0
    for k, i in enumerate(ids):
        assert got[i] == at
        at += 1 + k % 7


def test_speedups_sizes_and_profile(spark):
    times = spark.createDataFrame([("exact", 4.0), ("exact", 6.0), ("pruned", 2.0)], "name string, ms double")
    assert rows_of(evaluate.speedups(times, "name", "ms", "exact")) == [("exact", 5.0, 1.0), ("pruned", 2.0, 2.5)]
    sizes = evaluate.index_sizes(F.lit(1000), 64, F.lit(10), 8, 256)
    row = spark.range(1).select(*[v.alias(k) for k, v in sizes.items()]).first()
    assert row["index_bytes"] == 10 * 256 + 4000 + 8000 + 65536 + 4000 and abs(row["effective_ratio"] - 256_000 / row["index_bytes"]) < 1e-9
    prof = profile.stage_profile(spark, [("a", lambda: spark.range(10)), ("b", lambda: spark.range(20))], runs=1).collect()
    assert [r["stage"] for r in prof] == ["a", "b"] and all(r["ms"] > 0 for r in prof) and abs(sum(r["pct"] for r in prof) - 100) < 1e-6
    arms = spark.createDataFrame([(False, 0.5), (True, 0.6)], "augment boolean, ndcg double")
    assert evaluate.ab_compare(arms, "augment", False, True).first()["verdict"] == "better"


def test_metrics_by_settings_keep_every_judged_query(spark):
    n = 1_000_003
    qrels = spark.range(n).select(F.col("id").alias("query_id"), F.lit(1).alias("doc_id"), F.lit(1).alias("relevance"))
    results = spark.createDataFrame([(2, 0, 1, 1.0, 1), (8, 0, 1, 1.0, 1)], "nprobe int, query_id long, doc_id int, score double, rank int")
    got = evaluate.query_metrics(results, qrels, by=("nprobe",)).groupBy("nprobe").count().collect()
    assert sorted(map(tuple, got)) == [(2, n), (8, n)]
