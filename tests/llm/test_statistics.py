"""Phrases, document fingerprints and the filter audit against brute force, on small tables with every kind of odd row."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodeseek.llm import audit, langid, multiset, phrases

RNG = random.Random(11)
WORDS = [a + b for a in "bdfgkl" for b in ("a", "en", "ist", "é")]


def words(n, pool=WORDS):
    return " ".join(RNG.choice(pool) for _ in range(n))


def line(n):
    return ", ".join(words(RNG.randint(3, 9)) for _ in range(n)) + "."


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


# Filter audit

LONG = words(60) + " " + " ".join(f"x{i}" for i in range(90))
AUDITED = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (None, LONG, "a"), (None, LONG, None), (3, None, "a"), (4, "", None), (5, "few words", "b"), (6, "few words #", "b"),
    (7, "SHOUT " * 60, "c"), (8, LONG + " 100%", "c"), (9, LONG.upper(), "c"), (9, "other text of one id", "c"), (0, LONG + "  x", "a"), (10, " ".join("pq"[i % 2] + str(i) for i in range(49)), "a"), (11, " ".join("pq"[i % 2] + str(i) for i in range(50)), ""), (12, LONG, "z"),
]
MARKS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (5, 0, 1), (7, None, 1), (None, 1, 1), (77, 1, 1), (12, 1, None)]


def audited(rows, marks):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    facts = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        facts.append((part or "", dict(zip("ABCDE", fails, strict=True)), i in good, i in toxic))
    out = {}
    shapley = Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                k, before = order[step - 1], order[: step - 1]
                here = [f for f in own if f[1][k] and not any(f[1][b] for b in before)]
                shapley[part, k] += len(here)
                out[part, "".join(order), step] = [
                    sum(not any(f[1][b] for b in order[:step]) for f in own), len(here), sum(f[1][k] and any(f[1][b] for b in before) for f in own),
                    sum(f[1][k] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in here), sum(f[3] for f in here),
                ]
    return [(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()]


def test_audit(spark):
    docs = spark.createDataFrame([(*r, "extra") for r in AUDITED], "doc_id long, text string, source string, _id string").repartition(4)
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, labels).collect()
    assert shown(got) == shown(audited(AUDITED, MARKS))
    assert audit.audit(docs.where("doc_id = 99"), labels).count() == 0
    assert audit.audit(docs, labels.where("doc_id = 99")).agg(F.sum("good_lost")).first()[0] == 0


def test_chains_hold_colliding_texts_apart():
    chains = audit.Chains()
    rows = [(5, b"one"), (7, b"two"), (3, b"one"), (7, b"two"), (9, b"two")]
    known = [x for i, t in rows for x in chains.add(1, t, i, 0, "p")]
    assert sorted(known) == [(5, "p", audit.COPY, 1), (9, "p", audit.COPY, 1)]
    assert sorted((e[0], e[1], e[3]) for _, e in chains.drain()) == [(b"one", 3, {"p": 1}), (b"two", 7, {"p": 2})]
    sent = [((1, 3), (b"one", 3, 0, {"p": 1})), ((1, 4), (b"two", 4, 2, {"p": 1})), ((1, 4), (None, 4, 1, {"q": 2})), ((1, 6), (b"one", 6, 0, {"q": 1})), ((2, 1), (b"one", 8, 0, {"p": 1}))]
    assert sorted(audit._settle(iter(sent))) == [(3, "p", 0, 1), (4, "p", 2, 1), (4, "q", 1, 2), (6, "q", audit.COPY, 1), (8, "p", 0, 1)]


# Phrases


def collocations(rows, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= phrases.LEAST}
        held = {q for p, a in often.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in often and 100 * a >= 50 * often[q]}
        scored = []
        for p, a in often.items():
            if p not in held:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), lang, counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, _, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, top):
    few = WORDS[:7]
    rows = [(line(30), "en") for _ in range(20)] + [(words(200, few), "de") for _ in range(6)] + [(words(60, few).upper() + "\tÉ ß\x0bx", None) for _ in range(8)]
    rows += [(None, "en"), ("", None), ("\n.,;  \t", "fr"), ("new york\tcity! " * 40, "fr"), ("a  a a a a a a a a a a a a a", "und")] + [("Same text, same words.", "en")] * 15
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(3)
    got = phrases.collocations(docs, top).collect()
    assert shown(got) == shown(collocations(rows, top))
    assert phrases.collocations(docs.where("doc_id < 0"), top).count() == 0


def test_nothing_frequent_is_lost_in_a_full_sketch(spark):
    """Far more n-grams than a sketch has room for: estimates are too high, counts stay exact."""
    rows = [(words(400, [f"w{i}" for i in range(400)]), "en") for _ in range(30)] + [("rare pair here. " * 4, "en")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    bits = phrases.sketch(docs, phrases.BLOCK)
    assert bits.shape == (phrases.ROWS, phrases.BLOCK // 8) and bits.any()
    bits[:] = 255  # as if every cell had been filled
    sent = spark.sparkContext.broadcast(bits)
    parts = phrases.arrow(docs, phrases._counted(sent, phrases.BLOCK, 5), "share int, lang string, phrases binary, counts binary, sizes array<long>").repartition(2, "share").sortWithinPartitions("share")
    got = phrases.arrow(parts, phrases._totals, "lang string, phrase string, f long").select("phrase", "f")
    assert shown(got.collect()) == shown(phrases.phrase_counts(docs).select("phrase", "f").collect())


# Fingerprints


def test_document_fingerprints(spark):
    texts = [line(4) + "\n" + line(3) + "\n" + line(5) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "another text of this id"), (40, texts[5]), (41, None), (42, ""), (43, "é"), (44, "日本語 " * 900), (None, "no id"), (None, "no id"), (50, "\n".join(reversed(texts[7].split("\n")))), (-5, "x" * 50)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(4)
    got = multiset.compare_edited(docs).collect()
    # Descending ids, hashes among rows of one id, null ids last.
    keys = {t: h for t, h in map(tuple, spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct().select("t", F.xxhash64("t")).collect())}
    places = sorted({(i, t or "") for i, t in rows}, key=lambda p: (p[0] is None, -(p[0] or 0), -keys[p[1]]))
    want, after = {}, {p: places[(k + 1) % len(places)] for k, p in enumerate(places)}
    for i, t in places:
        m = len(t) // 3
        want[i, t] = hashlib.sha256((t[: len(t) - m] + after[i, t][1][:m]).encode()).hexdigest()
    assert shown((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == shown((i, len(t or ""), want[i, t or ""]) for i, t in rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    assert by[40]["fingerprint"] == by[5]["fingerprint"] and by[41]["fingerprint"] == by[42]["fingerprint"] and by[50]["fingerprint"] == by[7]["fingerprint"]
    assert len({r["fingerprint"] for r in got}) == len({tuple(sorted((t or "").split("\n"))) for _, t in rows})
    for i in range(4, 29):
        assert by[i]["near_edited"] > 0.3 > by[i]["near_next"] >= 0 and by[i]["near_edited"] <= 1
    assert by[42]["near_next"] == 1 and by[42]["near_edited"] == 1 and by[43]["near_next"] == 0
    assert multiset.compare_edited(docs.where("doc_id = 99")).count() == 0
    one = multiset.compare_edited(docs.where("doc_id = 43")).first()
    assert one["edited_sha256"] == hashlib.sha256("é".encode()).hexdigest() and one["near_next"] == 1


def test_paragraphs_put_in_and_taken_out(spark):
    a, b, c = line(4), line(3) + "\n" + line(2), "same line.\n" * 20000 + "end"
    rows = [("a", a), ("b", b), ("ab", a + "\n" + b), ("ba", b + "\n" + a), ("c", c), ("ac", a + "\n" + c), ("bb", b + "\n" + b)]
    fp = multiset.fingerprints(spark.createDataFrame(rows, "k string, text string"), ["k"], "text")
    have = dict(map(tuple, fp.collect()))
    x = fp.alias("x").join(fp.alias("y"))
    both = {(r[0], r[1]): (r[2], r[3], r[4]) for r in x.select("x.k", "y.k", multiset.insert(F.col("x.fp"), F.col("y.fp")), multiset.delete(F.col("x.fp"), F.col("y.fp")), multiset.likeness(F.col("x.fp"), F.col("y.fp"))).collect()}
    assert have["ab"] == have["ba"] == both["a", "b"][0] and have["ac"] == both["a", "c"][0] == both["c", "a"][0] and have["bb"] == both["b", "b"][0]
    assert both["ab", "b"][1] == have["a"] and both["ac", "c"][1] == have["a"] and both["ac", "a"][1] == have["c"] and both["bb", "b"][1] == have["b"]
    assert both["ab", "ba"][2] == 1 and both["ab", "a"][2] > 0.5 and both["a", "b"][2] < 0.5 and both["bb", "b"][2] > 0.99
    copies = multiset.fingerprints(spark.createDataFrame([("a", a)] * 5, "k string, text string").repartition(3), ["k"], "text", copies=True)
    assert copies.first()["fp"] == have["a"]


# Many languages


def test_thousands_of_languages(spark):
    rows = [(i, "ba be " + str(i), f"l{i % 2600:04d}") for i in range(5200)] + [(10_000 + i, "zul zum", "often") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    usable = table.where(~langid.held_out())
    found = langid.chosen_documents(usable)
    have = Counter(lang for lang, _ in found)
    assert set(have) == {r["lang"] for r in usable.select("lang").distinct().collect()} and max(have.values()) <= 3
    assert have["often"] >= 2
    few = Counter(lang for lang, _ in langid.chosen_documents(usable, total=40))
    assert len(few) == 20 and "often" in few and max(few.values()) == 2
    model = langid.train(table, total=1200)
    assert len(model.languages) == 600 and "often" in model.languages
    assert langid.identify(table.where("doc_id >= 10000"), model).where("lang_pred = 'often'").count() == 50
