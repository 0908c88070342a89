"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bytebpe, embedup, langid, linededup, multiset, packing, phrases, pii, simhash, substring, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), pii.application_key(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(_read(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_substrings(_read(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.compare_edited(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_simhash, op4_embedding_dedup, op5_line_dedup, op6_byte_bpe, op7_top_k, op8_language_id, op9_substring_dedup, op10_best_fit_packing, op11_collocations, op12_document_fingerprints, op13_filter_audit)}

ORACLES = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM u
  UNION
  SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT u.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, u.vec_id = m.component_id AS kept
FROM u
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = u.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = u.vec_id
""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
trimmed AS (
  SELECT doc_id, line, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM lines),
filled AS (
  SELECT doc_id, pos, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS s FROM trimmed WHERE t <> ''),
wins AS (
  SELECT doc_id, s, t AS a, lead(t, 1) OVER w AS b, lead(t, 2) OVER w AS c FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, s) AS r FROM wins WHERE c IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, s + k AS s FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1),
marked AS (
  SELECT f.doc_id, f.pos, f.s, g.s IS NOT NULL AS gone FROM filled f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.s = f.s),
around AS (
  SELECT t.doc_id, t.line, t.pos, t.t, m.gone,
    last_value(m.gone IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
    first_value(m.gone IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM trimmed t LEFT JOIN marked m ON m.doc_id = t.doc_id AND m.pos = t.pos),
judged AS (
  SELECT doc_id, line, pos, CASE WHEN t <> '' THEN gone ELSE coalesce(before AND after, false) END AS gone FROM around)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed
FROM judged GROUP BY doc_id
""",
    "op7_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM win) WHERE lo < doc_id),
words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
near AS (
  SELECT words.*, l.i AS i FROM words ASOF LEFT JOIN late l ON words.doc_id = l.doc_id AND words.p >= l.i)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM near WHERE i IS NULL OR p > i + 49 GROUP BY doc_id) k ON k.doc_id = d.doc_id
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
tokens AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM tokens),
f AS (
  SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w))
  GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f FROM f WHERE f >= 10),
cuts AS (
  SELECT lang, phrase, k, f AS a, c, array_to_string(w[1 : c], ' ') AS lp, array_to_string(w[c + 1 : k], ' ') AS rp
  FROM often, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (
  SELECT x.lang, x.phrase, x.k, x.a, x.c, l.f AS l, r.f AS r, (1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp),
least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_pairs AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM often WHERE k = 3),
held AS (
  SELECT * FROM least s WHERE NOT EXISTS (
    SELECT 1 FROM inner_pairs p WHERE p.lang = s.lang AND p.phrase = s.phrase AND s.k = 2 AND 100 * p.f >= 50 * s.a)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM held)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
    "op13_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
facts AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
     regexp_matches(t, '[#$%&*|]'), x.doc_id > min(x.doc_id) OVER (PARTITION BY t)] AS fails
  FROM words x LEFT JOIN marks m ON m.doc_id = x.doc_id),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT o, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, i AS step FROM orders, letters),
counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY part, fails),
judged AS (
  SELECT part, filter_order, step, o[step] AS f, n, good, toxic, coalesce(fails[o[step]], false) AS bad,
    coalesce(list_bool_or(list_transform(o[1 : step - 1], lambda x: coalesce(fails[x], false))), false) AS before,
    len(list_filter(fails, lambda x: coalesce(x, false))) = 1 AS alone
  FROM counted, steps),
told AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT bad AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (WHERE bad AND NOT before), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE bad AND before), 0) AS redundant, coalesce(sum(n) FILTER (WHERE bad AND alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE bad AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE bad AND NOT before), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM told
""",
}
