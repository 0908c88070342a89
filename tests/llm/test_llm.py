"""The training-data operators against brute force, on small tables with every kind of odd row."""

import datetime
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeseek.llm import bytebpe, components, embedup, langid, linededup, packing, pii, simhash, substring, topk, toxicity
from lodeseek.llm.common import checkpoint, flat
from lodeseek.llm.tokens import read_ranks

random.seed(5)
WORDS = [a + b for a in "bdfgklmn" for b in ("a", "en", "ist", "ou", "é")]
RUN = " ".join(random.choice(WORDS) for _ in range(70))


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


LONG = text(8_000)
TEXTS = [text(200), RUN + " x " + text(20), None, "", "   \n", text(30) + " " + RUN, "a", "a b", "A B", LONG, LONG, LONG[:3000] + " new " + LONG[3000:], "same " * 400, "same " * 300, RUN, "Straße ÉÀ 日本 😀", "1 2 3 !!!"]
ROWS = [(i, t, "x", i % 3) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", 0), (14, "other text for the same id", "y", 1), (None, RUN, None, None)]
SCHEMA = "doc_id long, text string, fp string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, empty):
    got = simhash.simhash_groups(docs).collect()
    fps = [fingerprint(r[1]) for r in ROWS]
    group = list(range(len(ROWS)))
    for i, j in itertools.combinations(range(len(ROWS)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = lambda i: min((r[0] for r, g in zip(ROWS, group, strict=True) if g == group[i] and r[0] is not None), default=None)
    want = [(r[0], f"{fps[i]:016x}", least(i)) for i, r in enumerate(ROWS)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_first(docs)
    names = {least(i) for i in range(len(ROWS))} - {None}
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in ROWS if r[0] is None or r[0] in names)


@pytest.mark.parametrize("wide", [1, 256])
def test_fingerprint_links(spark, wide, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {0, *base}
    for b in base:
        for _ in range(30):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = [tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    want = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert sorted(got) == sorted(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (300, 200), (300, 250)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(51)) and got[100] == got[101] == 100 and got[250] == got[300] == 200


@pytest.mark.parametrize("limit", [100, 3000, substring.LIMIT])
def test_substring(docs, empty, limit):
    """With a low limit all groups are split by longer signatures, down to the whole prefix."""
    got = sorted(map(str, map(tuple, substring.digest(substring.dedup_substrings(docs, limit=limit)).collect())))
    known = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    alone = RUN.encode().split()
    want = substring.brute_force(known) + [(None, len(alone), 0, hashlib.sha256(b" ".join(alone)).hexdigest())]
    assert got == sorted(map(str, want))
    assert substring.dedup_substrings(empty).count() == 0


def test_lines(spark, empty):
    block = "one\ntwo \nthree\nfour"
    rows = [(1, block + "\nfive"), (2, "zero\n" + block.replace(" ", "") + "\n\nlast"), (3, "one\ntwo\nsix"), (4, None), (5, ""), (6, "r\nr\nr\nr\nr"), (7, "one\n\ntwo\n\nthree"), (None, block), (2, "zero\nother")]
    names = "doc_id long, text string, starts string, n_lines int, row_key int, hit_id int, `a.b``c` int, seeds int, _row_key int"
    docs = spark.createDataFrame([(*r, "x", 9, 1, 2, 3, 4, 5) for r in rows], names)
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "starts", "row_key", "hit_id", "a.b`c", "seeds", "_row_key", "n_lines", "n_removed"]
    collected = out.collect()
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in collected}
    assert got == {(1, block + "\nfive", 0), (2, "zero\n\nlast", 4), (3, "one\ntwo\nsix", 0), (4, None, 0), (5, "", 0), (6, "r", 4), (7, "", 5), (None, block, 0), (2, "zero\nother", 0)}
    assert {tuple(r)[2:8] for r in collected} == {("x", 1, 2, 3, 4, 5)}
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in linededup.dedup_lines(docs.where("doc_id <> 2 or text like '%last'"), with_runs=True).collect() if r["runs"]}
    assert runs == {2: [(1, 4, 1, 0)], 6: [(1, 3, 6, 0), (2, 3, 6, 0)], 7: [(0, 3, 1, 0)]}
    assert linededup.dedup_lines(empty).count() == 0


def test_lines_match_brute_force(spark):
    """Random documents of few different lines, repeated rows among them, against a dictionary of all windows; one very long document."""
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(500, "\n".join(f"line {i % 5000}" for i in range(20_000))), rows[3], rows[3]]
    first: dict = {}
    for i, t in sorted(set(rows)):
        lines = t.split("\n") if t else []
        for k in range(len(lines) - 2):
            first.setdefault(tuple(lines[k : k + 3]), (i, k))
    want = []
    for i, t in rows:
        lines = t.split("\n") if t else []
        gone = {k + j for k in range(len(lines) - 2) if first[tuple(lines[k : k + 3])] != (i, k) for j in range(3)}
        want.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got) == sorted(want)


def test_settings_stay(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    try:
        assert linededup.dedup_lines(docs).count() == substring.dedup_substrings(docs).count() == len(ROWS)
        assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.unset(key)


def test_checkpoints_need_a_shared_folder():
    none = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint(df)


ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(bytebpe.RANKS)), special_tokens={})


def test_bpe(docs, empty):
    got = sorted(map(str, map(tuple, bytebpe.round_trip(docs).collect())))
    want = []
    for r in ROWS:
        ids = ENCODING.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(map(str, want))
    assert bytebpe.round_trip(empty).count() == 0
    back = bytebpe.decode(bytebpe.encode(docs.where("doc_id is not null")))
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r[0], r[1] or "") for r in ROWS if r[0] is not None}
    spans = bytebpe.encode(docs.where("doc_id = 15"), with_offsets=True).first()
    assert spans["char_start"][0] == 0 and spans["char_end"][-1] == len(TEXTS[15])


LIBRARY = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aA1-=. \n\t'sé日 　\x1c\x0b😀́Σß")), max_size=80) | st.text(max_size=40))
def test_chunks_equal_whole_texts(t):
    try:
        t.encode()
    except UnicodeEncodeError:
        return
    ids, first, *_ = bytebpe.encoder(public_tokenizers.path(bytebpe.RANKS)).batch(*flat(pa.array([t, "x", t])))
    assert ids[first[0] : first[1]].tolist() == ids[first[2] : first[3]].tolist() == ENCODING.encode_ordinary(t)
    words = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    ids, first, *_ = words.batch(*flat(pa.array(["<|end", t, "oftext|>"])))
    assert ids[first[1] : first[2]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_packing(spark, docs, empty):
    special = [(90, "hello <|endoftext|> world <|ENDOFTEXT|>", "", 0), (91, "<|startoftext|>", "", 0)]
    rows = packing.pack_documents(docs.union(spark.createDataFrame(special, SCHEMA)), capacity=512).toPandas()
    want = []
    for r in [*ROWS, *special]:
        ids = np.array([*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(r[0], k, k * 512, len(p := ids[k * 512 : k * 512 + 512]), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 512))]
    got = [(None if np.isnan(a) else int(a), *b) for a, *b in rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(str, got)) == sorted(str((a, *map(int, b))) for a, *b in want)
    assert 49407 in LIBRARY.encode(special[0][1], add_special_tokens=False).ids
    packed_well(rows, 512)
    assert packing.pack_documents(empty).count() == 0


def packed_well(rows, capacity):
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= capacity and (g["length"].cumsum() - g["length"] == g["offset"]).all()


def test_swaps_save_sequences(spark):
    """Documents for which best fit alone needs more sequences, even from the largest on: the search saves some, over groups of 64 documents too."""
    rng = random.Random(3)
    sizes = [rng.choice((40, 60, 90, 130, 200, 230, 330)) + rng.randint(0, 9) for _ in range(900)]
    table = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(4)
    least = -(-sum(n + 1 for n in sizes) // 512)
    one = packing.pack_documents(table, capacity=512).toPandas()
    packed_well(one, 512)
    order = one.sort_values("doc_id")["length"].tolist()
    plain = [len(packing.best_fit(x, 512)) for x in (order, sorted(order, reverse=True))]
    assert least <= one["sequence_id"].nunique() < min(plain)
    many = packing.pack_documents(table, capacity=512, group=64).toPandas()
    packed_well(many, 512)
    assert len(many) == 900 and many["sequence_id"].nunique() <= one["sequence_id"].nunique() + 8


def test_repeated_rows_are_spread(spark):
    table = spark.createDataFrame([(i % 2, "a b c") for i in range(4000)], "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(table, capacity=64, group=100).toPandas()
    packed_well(rows, 64)
    assert len(rows) == 4000 and rows["sequence_id"].nunique() == 250
    assert len({x >> 24 for x in rows["sequence_id"]}) > 30


def test_local_search_empties_bins():
    rng = random.Random(1)
    lengths = [rng.randint(1, 70) for _ in range(400)]
    start = [[i] for i in range(400)]
    bins = packing.local_search(start, lengths, 100, passes=50)
    assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.12 * -(-sum(lengths) // 100)
    # 6+4 and 5+5 fill two bins of 10; from {6,3}, {5,4}, {5} a swap has to make the room.
    assert len(packing.local_search([[0, 1], [2, 3], [4]], [6, 4, 5, 4, 1], 10)) == 2
    # Nothing fits whole: 7 goes for 4 + 2, and what comes out fits elsewhere.
    assert len(packing.local_search([[0, 1, 2], [3], [4]], [4, 2, 3, 7, 4], 10)) == 2
    assert packing.best_fit([], 10) == [] and packing.local_search([], [], 10) == []


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 6))
    near = x[:10] + rng.standard_normal((10, 6)) * 0.05
    rows = [[float(v) for v in r] for r in np.concatenate((x, near, near[:3]))]
    rows += [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, []]
    return rows, spark.createDataFrame([(i, v, i % 2, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int, mult string")


def usable(v):
    return v is not None and len(v) and None not in v and all(np.isfinite(v))


@pytest.mark.parametrize("tile", [2, 512])
def test_embeddings(spark, tile):
    rows, table = vectors(spark)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedup.near_duplicates(table, recall=0.999999, tile=tile).collect()}
    x = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in enumerate(rows) if usable(v) and any(v)}
    link = {(a, b) for a in x for b in x if a != b and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.95}
    root = {i: i for i in range(len(rows))}
    for _ in rows:
        for a, b in link:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (sum(a == i for a, _ in link), root[i], root[i] == i) for i in root}
    assert embedup.near_duplicates(table.limit(0)).count() == 0


def test_bits_follow_the_number_of_vectors():
    plans = [embedup.plan(n) for n in (1, 10**6, 10**9, 10**13)]
    assert [b for b, _ in plans] == [4, 8, 18, 32] and all((1 - (1 - (1 - math.acos(0.95) / math.pi) ** b) ** t) >= 0.99 for b, t in plans)


def test_dense_groups_count_every_link(spark):
    """400 near copies of one vector, and repeated rows: all pairs link, over several tiles and strips."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal(16) + 0.02 * rng.standard_normal((400, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + k, [float(v) for v in x[0]]) for k in range(20)]
    got = embedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), tile=64).collect()
    assert {tuple(r)[1:3] for r in got} == {(419, 0)} and sum(r["kept"] for r in got) == 1


def test_top_k(spark):
    rows, table = vectors(spark)
    got = sorted(map(tuple, topk.top_k(table, every=5, pivots=4).collect()))
    q = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in enumerate(rows) if v is not None and None not in v and all(np.isfinite(v))}
    want = []
    for i in q:
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), j) for j in q if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.top_k(table.limit(3), every=1).count() == 6
    best = got[0][2]
    same = topk.top_k(table.union(table.where(F.col("vec_id") == best)), every=5, pivots=4).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in same][:2] == [best, best] and len(same) == 5


def test_bounds_exclude_cells(spark):
    """On clustered vectors most candidates are never scored, and the results are those of a full scan."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 300, axis=0) + 0.04 * rng.standard_normal((9000, 16))
    x = x[rng.permutation(len(x))].astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = topk.searched(table, cell=512).cache()
    assert found.agg(F.sum("scored")).first()[0] < 0.4 * 9000 * 180
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = {}
    for r in topk.top_k(table, cell=512).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for i in range(0, 9000, 50):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(q)), -scores)) if j != i][:5]
        assert [got[i][k + 1] for k in range(5)] == [(j, scores[j]) for j in order]


def test_languages(spark, docs, empty):
    pools = {"aa": "ba be bi bo", "bb": "kra kre kri", "cc": "zul zum zun"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(pools[p].split()) for _ in range(30)), p) for i, p in enumerate([*pools] * 40)]
    rows += [(900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (None, "ba ba", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    out = langid.identify(table.withColumn("score", F.lit("x")), model).withColumn("h", langid.held_out()).collect()
    assert all(r["lang_pred"] == r["lang"] for r in out if (r["doc_id"] or 0) < 900) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out if (r["doc_id"] or 0) >= 900} == {i: ("und", 0.0) for i in (900, 901, 902)}
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    odd = langid.identify(docs.withColumn("a.b", F.lit(1)), model).collect()
    assert len(odd) == len(ROWS) and {r["lang_pred"] for r in odd if r["doc_id"] in (2, 3, 4)} == {"und"} and {r["a.b"] for r in odd} == {1}
    none = langid.identify(docs, langid.train(table.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and langid.identify(empty, None).count() == 0
    code = langid.codewords(12)
    assert len({tuple(r) for r in code}) == 12 and langid.codewords(1).shape == (1, 0)


def test_languages_equal_a_plain_fit(spark):
    """The same sample, n-grams, ridge regressions and decoding, spelt out with dictionaries and a plain solver."""
    rng = random.Random(6)
    pools = {"aa": "ba be bi bo kra", "bb": "kra kre kri ba", "cc": "zul zum kre"}
    rows = [(i, " ".join(rng.choice(pools[p].split()) for _ in range(6)), p) for i, p in enumerate([*pools] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, langid.train(table, sample=25)).collect()}

    def features(t):
        x, total = np.zeros(langid.BUCKETS), 0
        raw = [b if b >= 97 and b < 123 or b >= 128 else 32 for b in t.lower().encode()]
        for n in (2, 3):
            for i in range(len(raw) - n + 1):
                code = 0
                for b in raw[i : i + n]:
                    code = (code * 257 + b) % 2**32
                x[(code * 2654435761 % 2**32) >> 20] += 1
                total += 1
        return np.sqrt(np.float64(x) / total).astype(np.float32).astype(np.float64)

    def signed_hash(i):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)
        return h - 2**64 if h >> 63 else h

    chosen = []
    for lang in pools:
        own = sorted((signed_hash(i), i) for i, _, p in rows if p == lang and zlib.crc32(str(i).encode()) % 4 != 2)
        chosen += [(i, lang) for _, i in own[:25]]
    chosen.sort(key=lambda c: (c[0] * 0x9E3779B97F4A7C15) % 2**64)
    texts, names = {i: t for i, t, _ in rows}, sorted(pools)
    x = np.array([features(texts[i]) for i, _ in chosen])
    code = np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1]])
    y = code[[names.index(p) for _, p in chosen]].astype(float)

    def ridge(x, y):
        m, b = x.mean(axis=0), y.mean(axis=0)
        w = np.linalg.lstsq(np.vstack((x - m, np.sqrt(1e-3 * len(x)) * np.eye(x.shape[1]))), np.vstack((y - b, np.zeros((x.shape[1], y.shape[1])))), rcond=None)[0]
        return lambda z: (z - m) @ w + b

    aside = np.arange(len(x)) % 3 == 2
    f = ridge(x[~aside], y[~aside])(x[aside])
    good = 1 / (0.02 + np.exp(-np.clip(f * y[aside], -3, 3)).mean(axis=0))

    def decode(f, sharpness):
        loss = np.array([[sum(g * np.exp(-c * np.clip(v, -3, 3)) for g, c, v in zip(good / good.sum(), word, out, strict=True)) for word in code] for out in f])
        p = np.exp(-sharpness * (loss - loss.min(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    truth = [names.index(p) for (_, p), a in zip(chosen, aside, strict=True) if a]
    sharpness = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=lambda s: -np.log(np.maximum(decode(f, s)[np.arange(len(f)), truth], 1e-9)).mean())
    p = decode(ridge(x, y)(np.array([features(t) for _, t, _ in rows])), sharpness)
    for (i, _, _), q in zip(rows, p, strict=True):
        assert got[i][0] == names[int(q.argmax())] and abs(got[i][1] - q.max()) < 1e-4


def test_language_sample_is_cut_for_each_language(spark):
    """Neither many rows of one id nor many of one language crowd out another language."""
    free = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "ba be " + str(i), "aa") for i in free[:300]] + [(free[400], "kra kre", "bb")] * 500 + [(i, "zul zum", "cc") for i in free[500:530]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    usable = table.where(~langid.held_out())
    counts = Counter(lang for lang, _ in langid.chosen_documents(usable, sample=20))
    assert counts == {"aa": 20, "bb": 1, "cc": 20}
    assert Counter(lang for lang, _ in langid.chosen_documents(usable, sample=20, total=30)) == {"aa": 10, "bb": 1, "cc": 10}
    model = langid.train(table, sample=20)
    assert model.languages == ["aa", "bb", "cc"]
    out = langid.identify(table, model).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in out} == {(x, x) for x in model.languages}


def test_wide_systems_agree():
    """Ridge regression gives the same with more rows than features as through rows."""
    rng = np.random.default_rng(1)
    x, y = rng.random((50, 20)), rng.random((50, 2))
    w, b = langid._least_squares(x, y)
    centred = x - x.mean(axis=0)
    gram = centred @ centred.T + 1e-3 * 50 * np.eye(50)
    assert np.allclose(w, centred.T @ np.linalg.solve(gram, y - y.mean(axis=0))) and np.allclose(b, y.mean(axis=0) - x.mean(axis=0) @ w)


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, text(40) + (" dreadful awful" if i % 4 == 0 else "")) for i in range(400)]
    table = spark.createDataFrame([*rows, (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, rng.randint(0, 1), int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(table, labels)
    out = {r["doc_id"]: r for r in toxicity.score(table, chain).collect()}
    assert all(out[i]["toxic_pred"] == (i % 4 == 0) for i in range(1, 400, 2)) and not out[999]["toxic_pred"]
    assert toxicity.train(table, labels.limit(0)) is None and toxicity.train(empty, labels) is None
    assert {r["p_toxic"] for r in toxicity.score(docs, None).collect()} == {0.0}
    odd = toxicity.score(docs, chain).collect()
    assert len(odd) == len(ROWS) and not any(r["toxic_pred"] for r in odd) and len({tuple(r) for r in odd if r["doc_id"] == 0}) == 1
    assert toxicity.score(empty, chain).count() == 0


def test_unknown_labels_are_left_out(spark):
    """Documents whose toxicity is not known are not taken for clean ones; contradictory labels count as positive, in one row."""
    rows = [(i, text(30) + (" dreadful" if i % 2 else "")) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, 0, i % 2) for i in range(60)]
    unknown = [(i, 1 - i % 2, None) for i in range(60, 300)]
    labels = spark.createDataFrame([*known, *unknown, (301, None, None), (None, 1, 1), (1, 0, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(table, toxicity.train(table, labels)).collect()
    assert all(r["toxic_pred"] == bool(r["doc_id"] % 2) for r in out)


def test_chain_equals_a_plain_one(spark):
    """The chain against dense matrices: the same word buckets, gradient steps, folds and inputs, written out."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "dreadful", "awful", "fine"]) for _ in range(rng.randint(1, 6))) for _ in range(90)]
    labels = np.array([[float("fine" in t), float("dreadful" in t or "awful" in t)] for t in texts])
    labels[5::7, 0] = np.nan
    row, bucket = toxicity.word_buckets(*flat(pa.array(texts)))
    names = np.unique(bucket)
    x = np.zeros((len(texts), len(names)))
    x[row, np.searchsorted(names, bucket)] = 1

    def plain(x, dense, y):
        n, pos, neg = len(y), max(1, y.sum()), max(1, len(y) - y.sum())
        seen, good = x.sum(axis=0), x.T @ y
        keep = seen >= 3
        scale = np.where(keep, np.abs(np.log(((good + 0.5) / (pos + 1)) / ((seen - good + 0.5) / (neg + 1)))), 0)
        z = np.column_stack((x * scale, dense, np.ones(n)))
        rate = 4 / (((x * scale) ** 2).sum(axis=1).max() + (dense**2).sum(axis=1).max(initial=0) + 1)
        w = v = np.append(np.zeros(z.shape[1] - 1), np.log(pos / neg))
        for t in range(150):
            grad = z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y)
            grad[:-1] += v[:-1]
            new = v - rate * grad / n**0.5
            v, w = new + t / (t + 3) * (new - w), new
        return lambda a, d: np.column_stack((a * scale, d, np.ones(len(a)))) @ w

    known = np.flatnonzero(~np.isnan(labels[:, 0]))
    none, inputs = np.zeros((len(texts), 0)), np.zeros(len(texts))
    first = plain(x[known], none[known], labels[known, 0])
    inputs[:] = first(x, none)
    for f in range(5):
        test = known[np.arange(len(known)) % 5 == f]
        train = known[np.arange(len(known)) % 5 != f]
        inputs[test] = plain(x[train], none[train], labels[train, 0])(x[test], none[test])
    logit = lambda z: np.log((p := np.clip(1 / (1 + np.exp(-z)), 1e-4, 1 - 1e-4)) / (1 - p))[:, None]
    second = plain(x, logit(inputs), labels[:, 1])
    want = np.column_stack((first(x, none), second(x, logit(first(x, none)))))
    got = toxicity.fit_chain(row, bucket, labels).probabilities(row, bucket, len(texts))
    assert np.allclose(got, 1 / (1 + np.exp(-want)), atol=1e-6)


def plain_feistel(left, right, a, b, key, tweak):
    for i in range(10):
        value = right if i % 2 == 0 else left
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{value}".encode()).hexdigest()[:15], 16)
        left, right = ((left + h) % a, right) if i % 2 == 0 else (left, (right + h) % b)
    return left, right


def plain_permute(symbols, alphabet, key, tweak):
    out, n = "", len(alphabet)
    value = lambda s: sum(alphabet.index(c) * n**k for k, c in enumerate(reversed(s)))
    spelt = lambda v, k: "".join(alphabet[v // n**j % n] for j in reversed(range(k)))
    for j in range(0, len(symbols), 24):
        part = symbols[j : j + 24]
        own = f"{tweak},{alphabet[:2]},{len(part)},{j // 24}"
        if len(part) == 1:
            a, b = {10: (2, 5), 26: (2, 13), 16: (4, 4)}[n]
            left, right = plain_feistel(*divmod(value(part), b), a, b, key, own)
            out += alphabet[left * b + right]
        else:
            u = len(part) // 2
            left, right = plain_feistel(value(part[:u]), value(part[u:]), n**u, n ** (len(part) - u), key, own)
            out += spelt(left, u) + spelt(right, len(part) - u)
    return out


def refilled(shape, kind, symbols):
    it = iter(symbols)
    return "".join(next(it) if c in kind else c for c in shape)


def plain_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def plain_mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def test_pii_equals_plain_python(spark):
    """Every format with one value, against a Feistel network written out in Python."""
    epoch = datetime.date(1800, 1, 1)

    def day(text, order):
        n = (datetime.datetime.strptime(text, order).date() - epoch).days
        a, b = plain_feistel(*divmod(n, 773), 189, 773, "k", "date")
        return (epoch + datetime.timedelta(days=a * 773 + b)).strftime(order)

    def card(text):
        digits = re.sub("[^0-9]", "", text)
        body = plain_permute(digits[:-1], pii.DIGITS, "k", "card")
        return refilled(text, "0123456789", body + str(-plain_luhn(body + "0") % 10))

    def iban(text):
        whole = text.replace(" ", "")
        body = whole[4:]
        body = refilled(body, pii.DIGITS, plain_permute(re.sub("[^0-9]", "", body), pii.DIGITS, "k", "iban:" + whole[:2]))
        body = refilled(body, pii.LETTERS.upper(), plain_permute(re.sub("[^A-Z]", "", whole[4:]).lower(), pii.LETTERS, "k", "iban:" + whole[:2]).upper())
        check = f"{98 - plain_mod97(body + whole[:2] + '00'):02d}"
        return refilled(text, pii.DIGITS + pii.LETTERS.upper(), whole[:2] + check + body)

    def ssn(text):
        area, group, serial = map(int, text.split("-"))
        a, b = plain_feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "k", "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"

    def address(text):
        o = list(map(int, text.split(".")))
        a, b = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "k", "ip")
        return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))

    def email(text):
        local, domain = text.split("@")
        letters = plain_permute(re.sub("[^a-z]", "", local.lower()), pii.LETTERS, "k", "email:" + domain)
        out = refilled(local, "abcdefghijklmnopqrstuvwxyz", letters)
        return refilled(out, pii.DIGITS, plain_permute(re.sub("[^0-9]", "", local), pii.DIGITS, "k", "email:" + domain)) + "@" + domain

    def phone(text, code=""):
        return code + refilled(text[len(code) :], pii.DIGITS, plain_permute(re.sub("[^0-9]", "", text[len(code) :]), pii.DIGITS, "k", "phone:" + code))

    def within(d, m, y, months, first, most, kind):
        lengths = [min(n, most) - first + 1 for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[:months]]
        days = [(mm + 1, k + first) for mm, n in enumerate(lengths) for k in range(n)]
        a, b = plain_feistel(y - 1800, days.index((m, d)), 400, len(days), "k", "date " + kind)
        return days[b][1], days[b][0], a + 1800

    half = "0123456789abcdef" * 4
    cases = {
        "2024-02-29": day("2024-02-29", "%Y-%m-%d"), "25/12/2020": day("25/12/2020", "%d/%m/%Y"), "25.12.2020": day("25.12.2020", "%d.%m.%Y"),
        "1/02/2021": "{}/{:02d}/{}".format(*within(1, 2, 2021, 12, 1, 9, "FalseTrue")), "1.2.2021": "{}.{}.{}".format(*within(1, 2, 2021, 9, 1, 9, "FalseFalse")),
        "12/3/2021": "{:02d}/{}/{}".format(*within(12, 3, 2021, 9, 1, 31, "TrueFalse")), "03/25/2021": "{1:02d}/{0}/{2}".format(*within(25, 3, 2021, 12, 13, 31, "month True")),
        "4111 1111 1111 1111": card("4111 1111 1111 1111"), "3782-822463-10005": card("3782-822463-10005"), "4111111111111111": card("4111111111111111"),
        "DE89370400440532013000": iban("DE89370400440532013000"), "GB82 WEST 1234 5698 7654 32": iban("GB82 WEST 1234 5698 7654 32"),
        "123-45-6789": ssn("123-45-6789"), "899-99-9999": ssn("899-99-9999"), "10.20.30.40": address("10.20.30.40"), "an.na7@mail.example": email("an.na7@mail.example"), "a@b.example": email("a@b.example"),
        f"{'x' * 90}@b.example": email(f"{'x' * 90}@b.example"), "+1 (212) 555-0100": phone("+1 (212) 555-0100", "+1"), "555.123.4567": phone("555.123.4567"), "555-123-4567": phone("555-123-4567"),
        f'key token="{half}"': f'key token="{plain_permute(half, pii.HEX, "k", "secret")}"', f'token="{half * 4}"': f'token="{plain_permute(half * 4, pii.HEX, "k", "secret")}"',
        "4111111111111112": "4111111111111112", "2023-02-30": "2023-02-30", "666-12-1234": "666-12-1234", "DE88370400440532013000": "DE88370400440532013000",
    }
    table = spark.createDataFrame([(i, f"see {t}; {t}") for i, t in enumerate(cases)], "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymise(table, "k").orderBy("doc_id").collect()]
    assert got == [f"see {t}; {t}" for t in cases.values()]


def test_pii(spark, docs, empty):
    rows = ["mail An.na7@mail.example and an.na7@mail.example", "card 4111 1111 1111 1111, 4111111111111111; no card 4111111111111112", "ip 10.20.30.40, not 10.20.30.400", "2024-02-29 and 2023-02-30", "+1 (212) 555-0100", 'token = "0123456789abcdef0123456789abcdef"', "plain words", "", None]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"n_pii": F.lit("x"), "found": F.lit(1), "pseudonyms": F.lit(2), "__found": F.lit(3), "a.b": F.lit(4)})
    out = [r for r in pii.pseudonymise(table, "k").orderBy("doc_id").collect()]
    assert [r["n_pii"] for r in out] == [2, 2, 1, 1, 1, 1, 0, 0, 0] and out[6]["text"] == rows[6] and out[7]["text"] == "" and out[8]["text"] is None
    assert {(r["found"], r["pseudonyms"], r["__found"], r["a.b"]) for r in out} == {(1, 2, 3, 4)}
    a, b = re.findall(r"\S+@mail.example", out[0]["text"])
    assert a.lower() == b and b != "an.na7@mail.example" and re.fullmatch(r"[A-Z][a-z]\.[a-z]{2}[0-9]@mail.example", a)
    c = re.findall(r"[0-9 ]{16,}", out[1]["text"])
    assert c[0].replace(" ", "") == c[1].replace(" ", "") and "4111111111111112" in out[1]["text"]
    assert "2023-02-30" in out[3]["text"] and "2024-02-29" not in out[3]["text"]
    same = sorted((str(r["doc_id"]), str(r["text"])) for r in pii.pseudonymise(docs, "k").collect())
    assert same == sorted((str(r[0]), str(r[1])) for r in ROWS) and pii.pseudonymise(empty, "k").count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000 + "a@b.example " + "9" * 200_000)], "doc_id long, text string")
    only = pii.pseudonymise(long, "k").first()
    assert only["n_pii"] == 1 and len(only["text"]) == 1_500_000 + 12 + 200_000
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


def test_feistel_permutes(spark):
    t = spark.range(1000).select("id", F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    new = {r["x"] for r in t.select(pii.permute(F.col("s"), pii.DIGITS, "k", F.lit("t")).alias("x")).collect()}
    assert len(new) == 1000 and all(re.fullmatch("[0-9]{3}", x) for x in new)
    for alphabet in (pii.DIGITS, pii.LETTERS, pii.HEX):
        one = spark.createDataFrame([(c,) for c in alphabet], "s string").select("s", *[pii.permute(F.col("s"), alphabet, k, F.lit("t")).alias(k) for k in ("k1", "k2", "k3")]).collect()
        for k in ("k1", "k2", "k3"):
            assert sorted(r[k] for r in one) == sorted(alphabet)
        # No constant shift: the distances between a symbol and its pseudonym differ.
        assert len({(alphabet.index(r["k1"]) - alphabet.index(r["s"])) % len(alphabet) for r in one}) > 1


def test_dates_permute_within_their_format(spark):
    days = spark.sql("SELECT explode(sequence(date'2019-12-01', date'2020-12-31')) AS d")
    for shape in ("d/M/yyyy", "dd/MM/yyyy", "M/dd/yyyy", "MM/dd/yyyy", "d.MM.yyyy", "dd.M.yyyy"):
        rows = days.select(F.date_format("d", shape).alias("text"))
        rows = rows.where("day(d) > 12") if shape.startswith("M") else rows
        out = pii.pseudonymise(rows.withColumn("old", F.col("text")), "k").collect()
        assert len({r["text"] for r in out}) == len(out) and all(re.sub("[0-9]", "9", r["text"]) == re.sub("[0-9]", "9", r["old"]) for r in out)
        assert sum(r["text"] == r["old"] for r in out) == 0
