import itertools
import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodeseek.llm import langid, linededup, nearcopies, packing, pii


def test_stages(spark, tmp_path):
    text = "\n".join(f"line {w} about the house and the garden by the river" for w in "abcdefgh")
    rows = [(1, text, "en", "s", 1), (2, text + "!", "en", "s", 1), (3, "mail a.bc12@mail.example to someone in the garden", "en", "s", 1), (4, None, "en", "s", 1), (5, "12 34", "en", "s", 1), (6, "das haus und der garten an dem fluss", "de", "s", 1)]
    rows += [(10 + i, f"the house number {i} and the river and the garden", "en", "s", 1) for i in range(20)] + [(40 + i, f"das haus und der fluss nummer {i} im garten", "de", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert at.columns == before.columns
        if name == "language_id":
            assert {4, 5}.isdisjoint({r["doc_id"] for r in at.collect()}) and at.count() == len(rows) - 2
        if name == "line_dedup":
            assert {r["text"] for r in at.where("doc_id = 2").collect()} == {"line h about the house and the garden by the river!"}
        if name == "pseudonyms":
            assert "a.bc12@mail.example" not in at.where("doc_id = 3").first()["text"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.exceptAll(at).count() == 0 and run.count() == at.count()


def _shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_reaches_similarity_08(spark):
    rng, texts = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 40))):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "a b", "A  b", "a c"]
    sets = [_shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([None, *set(group)], key=str) and len(set(group)) < len(texts) - 40


def test_line_dedup_counts_short_runs_by_content(spark):
    long = " ".join(f"w{i}" for i in range(50))
    half = [" ".join(f"{c}{i}" for i in range(25)) for c in "ab"]
    rows = [(1, f"one\n{long}\ntwo"), (2, f"three\n {long} "), (3, long), (4, "few words"), (5, "few words\n"), (6, "x\nfew words"), (7, "\n".join([*half, "tail"])), (8, "\n".join(["head", *half])), (9, half[0] + "\nother"), (10, "p\nq"), (11, "p\n\nq"), (12, "p"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    want = dict(rows) | {2: "three", 8: "head"}
    assert got == {k: t for k, t in want.items() if k not in (3, 5, 11)}
    plain = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert plain == dict(rows)


def test_members_of_a_band_are_linked_like_all_pairs():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) < keep], rng.integers(0, 1 << 60, 10, dtype=np.uint64)))) for keep in rng.uniform(0.75, 1, 60)]
    node, root = np.arange(60) * 7, np.arange(60) // 2 * 14
    known = {(int(root[i]), int(node[i])) for i in range(60)}
    near = {(i, j) for i, j in itertools.combinations(range(60), 2) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}

    def groups(edges):
        label = {int(n): int(n) for n in node}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    found = nearcopies.link_members(node, root, sets)
    assert groups(known | set(found)) == groups(known | {(int(node[i]), int(node[j])) for i, j in near})
    assert all((i, j) in near or (j, i) in near for i, j in ((a // 7, b // 7) for a, b in found)) and len(found) < 60


def plain_line_dedup(rows):
    """(doc_id, text) with different ids -> the same after line dedup, by dictionaries of all runs that count."""
    full = {i: [(k, x) for k, raw in enumerate(t.split("\n")) if (x := raw.strip(" \t\r\x0b\x0c"))] for i, t in rows}

    def runs(lines):
        for k in range(len(lines)):
            for n in (1, 2, 3):
                window = tuple(x for _, x in lines[k : k + n])
                if len(window) == n and (n == 3 or sum(len(x.split()) for x in window) >= 50):
                    yield k, n, window
                elif len(window) == n == len(lines):
                    yield k, n, ("whole", window)

    first: dict = {}
    for i in sorted(full):
        for k, _, window in runs(full[i]):
            first.setdefault(window, (i, k))
    out = []
    for i, t in rows:
        gone = sorted({k + j for k, n, window in runs(full[i]) if first[window] != (i, k) for j in range(n)})
        drop = {full[i][k][0] for k in gone}
        for a, b in itertools.pairwise(gone):
            if b == a + 1:
                drop.update(range(full[i][a][0], full[i][b][0]))
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)))
    return [(i, t) for i, t in out if t.strip(" ")]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept: lines and near copies by brute force, personal data row by row, sequences against the library."""
    rng = random.Random(12)
    words = {"en": "the house and garden by river was old in summer".split(), "de": "das haus und der garten an dem fluss war alt".split()}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en"]) for _ in range(n))
    lines = {k: [line(k, rng.choice((5, 12, 60))) for _ in range(40)] for k in words}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        body = [rng.choice(lines[lang]) for _ in range(rng.randint(1, 5))] if rng.random() < 0.6 else [line(lang, rng.randint(20, 90))]
        if i % 9 == 0:
            body.append(f"mail a{i}@mail.example or 12/03/20{10 + i % 80}")
        rows.append((i, "\n".join(body), lang))
    for i in range(160, 200):
        w = rows[i - 160][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), rows[i - 160][2]))
    rows += [(300, None, "en"), (301, "1 2 3", "en"), (302, "", None)]
    names = "doc_id long, text string, lang string, n_chars long, score string, n_lines int, `a.b` int"
    table = spark.createDataFrame([(i, t, lang, len(t or ""), "s", 7, 8) for i, t, lang in rows], names)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        before = at
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        outs.append((before, at))
        if name != "best_fit_packing":
            assert at.columns == before.columns and all(r["n_chars"] == len(r["text"]) and (r["score"], r["n_lines"], r["a.b"]) == ("s", 7, 8) for r in at.collect())
    known = langid.identify(table.drop("score"), langid.train(table)).where("lang_pred <> 'und' and not ambiguous")
    assert pairs(outs[0][1]) == pairs(known) and not {300, 301, 302} & {i for i, _ in pairs(known)}
    assert pairs(outs[1][1]) == plain_line_dedup(pairs(outs[1][0])) != pairs(outs[1][0])
    left = pairs(outs[2][0])
    sets = [_shingles(t) for _, t in left]
    group = list(range(len(left)))
    for i, j in itertools.combinations(range(len(left)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    assert pairs(outs[2][1]) == [left[i] for i in sorted(set(group))] != left
    assert pairs(outs[3][1]) == pairs(pii.pseudonymise(outs[3][0], pii.application_key(spark)))
    assert not any(re.search(r"\ba\d+@mail", t) and t == u for (_, t), (_, u) in zip(pairs(outs[3][0]), pairs(outs[3][1]), strict=True))
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs(outs[4][0])}
    packed = outs[4][1].toPandas()
    assert dict(zip(packed["doc_id"], packed["length"], strict=True)) == sizes
    assert packed["sequence_id"].nunique() == -(-sum(sizes.values()) // 4096) and (packed.groupby("sequence_id")["length"].sum() <= 4096).all()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
