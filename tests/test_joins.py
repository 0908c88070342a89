"""Nearest joins, medians, keywords and sub-words against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import encode, evaluate, passages, postings, subword
from lodeseek.operators import text as C


def test_nearest_match(spark):
    rng = random.Random(3)
    a = [(i, rng.choice([round(rng.uniform(-5, 5), 2), 1.5])) for i in range(200)] + [(900, None), (901, math.nan)]
    b = [(j, rng.choice([round(rng.uniform(-5, 5), 1), 1.25])) for j in range(60)] + [(3, 1.25), (70, None), (71, math.nan), (72, 1.75)]
    got = evaluate.nearest_match(spark.createDataFrame(a, "name int, x double"), spark.createDataFrame(b, "ord int, x double"), "x", 0.2)
    want = []
    for i, x in a:
        if x is not None and x == x:
            gap, j, v = min((round(abs(x - y), 9), j, y) for j, y in b if y is not None and y == y)
            if gap < 0.2:
                want.append((i, j, gap))
    rows = got.select("a.name", "b.ord", "gap")
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert evaluate.nearest_match(spark.createDataFrame([], "name int, x double"), spark.createDataFrame(b, "ord int, x double"), "x", 0.2).count() == 0
    with pytest.raises(ValueError):
        evaluate.nearest_match(got, got, "gap", 0)


def test_median(spark):
    rng = random.Random(5)
    rows = [(k, round(rng.uniform(0, 9), 1)) for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 400)) for _ in range(n)] + [("a", None)]
    got = dict(map(tuple, C.median(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()))
    assert got == pytest.approx({k: statistics.median(v for q, v in rows if q == k and v is not None) for k in "abcd"})


def test_thousands_of_keywords(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abÉc") for _ in range(n))
    texts = [(i, " ".join(word(rng.randint(1, 9)) for _ in range(40))) for i in range(60)] + [(None, "abc abc"), (70, None), (71, ""), (-1, "ab")]
    keywords = [word(rng.randint(1, 7)) for _ in range(4998)] + ["", "absent"]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, C.keyword_scan(docs, keywords).collect()), key=str)
    want = []
    for k in keywords:
        hit = [(i, t) for i, t in texts if t is not None and k.lower() in t.lower()]
        first = min(((i, t) for i, t in hit if i is not None), default=(None, None))
        want.append((k, len(hit), first[0], first[1] and first[1][:90]))
    assert got == sorted(want, key=str)


def greedy(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out


def test_subwords_equal_plain_greedy_matching(spark):
    rng = random.Random(8)
    word = lambda n, chars="abcd": "".join(rng.choice(chars) for _ in range(n))
    for _ in range(40):
        vocabulary = {rng.choice(["", "##"]) + word(rng.randint(1, 5)) for _ in range(rng.randint(1, 60))}
        if rng.random() < 0.7:
            vocabulary |= set("abcd") | {f"##{c}" for c in "abcd"}
        split = subword.Subwords(list(vocabulary))
        for _ in range(150):
            w = word(rng.randint(1, 14), "abcde")
            assert split.pieces(w) == greedy(w, vocabulary)
    split = subword.Subwords(["un", "##aff", "##able", "é", "##é", "[UNK]"])
    text = "unaffable  é\téé x " + "é" * 101
    tokens, starts, ends = split.spans(text)
    assert tokens == ["un", "##aff", "##able", "é", "é", "##é", "[UNK]", "[UNK]"] == split(text)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == ["un", "aff", "able", "é", "é", "é", "x", "é" * 101]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in subword.subwords(docs, split).collect()}
    assert (got[1]["tokens"], got[1]["starts"], got[1]["ends"]) == (tokens, starts, ends) and got[2]["tokens"] == got[3]["tokens"] == []
    table = spark.createDataFrame([("un",), ("##aff",), (None,), ("un",)], "piece string")
    assert subword.vocabulary_of(table).vocabulary == ["##aff", "un"]
    # The encoder takes it as its tokenizer: windows of sub-words.
    packed = passages.encode_windows(docs, encode.DigestEncoder(), 4, 1, tokenizer=split)
    asked = spark.createDataFrame([(0, 0, encode.DigestEncoder().vectors(["##able"])[0].tolist())], "query_id long, q_tok int, qvec array<double>")
    assert passages.holding(packed, asked).select(F.col("doc_id")).collect() == [(1,)]


def test_coded_posting_lists(spark):
    rng = random.Random(9)
    lists = {0: {rng.randrange(1 << 17) for _ in range(30_000)}, 1: set(range(5000)) | {1 << 40, -1, -70_000}, 2: {7}, 3: {rng.randrange(1 << 16) for _ in range(6000)}}
    rows = [(i, c) for c, ids in lists.items() for i in ids] + [(7, 2), (None, 2), (8, None)]
    rng.shuffle(rows)
    coded = postings.posting_blocks(spark.createDataFrame(rows, "token_id long, cluster_id int").repartition(3)).cache()
    held = lambda df: {k: {r["id"] for r in df.collect() if r["key"] == k} for k in {r["key"] for r in df.select("key").distinct().collect()}}
    assert held(postings.ids_of(coded)) == lists
    assert {r["key"]: r["s"] for r in coded.groupBy("key").agg(F.count("*").alias("s")).collect()} == {c: len({i >> 16 for i in ids}) for c, ids in lists.items()}
    assert coded.where("length(data) > 8192").count() == 0 and coded.where("length(data) = 8192 and n > 4096").count() >= 3
    wanted = {0: {0, 1, 2, 3}, 1: {2}, 2: {1, 3}, 3: {9}}
    union = postings.union_of(coded, spark.createDataFrame([(q, c) for q, cs in wanted.items() for c in cs] + [(1, 2)], "query_id long, cluster_id int"))
    want = {q: set().union(*(lists.get(c, set()) for c in cs)) for q, cs in wanted.items()}
    assert held(postings.ids_of(union)) == {q: ids for q, ids in want.items() if ids}
    assert all(r["n"] == len([i for i in want[r["key"]] if i >> 16 == r["span"]]) for r in union.collect())
    for a, b in ((0, 2), (0, 1), (1, 2), (2, 0)):
        moved = union.where(F.col("key") == b).withColumn("key", F.lit(a).cast("long"))
        got = held(postings.ids_of(postings.intersection_of(union.where(F.col("key") == a), moved)))
        assert got == ({a: want[a] & want[b]} if want[a] & want[b] else {})
    assert postings.posting_blocks(spark.createDataFrame([], "token_id long, cluster_id int")).count() == 0
    coded.unpersist()
