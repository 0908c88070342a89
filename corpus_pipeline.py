"""A training corpus from the table documents: language, repeated lines, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, n_chars
following the text, whatever other columns are called. Null texts are rejected by the first stage; empty tables pass
through as empty, repeated rows and null ids as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import langid, linededup, nearcopies, packing, pii
from lodeseek.llm.common import checkpoint, fresh, quoted


def _aside(docs: DataFrame, made: tuple[str, ...], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``apply`` makes of docs, with the columns of docs: those whose names it gives to columns of its own are renamed meanwhile."""
    own = [c for c in docs.columns if c in made]
    saved = dict(zip(own, fresh(docs, *[f"own_{c}" for c in own]), strict=True))
    new = apply(docs.toDF(*[saved.get(c, c) for c in docs.columns]))
    length = F.length("text").cast("long")
    return new.select(*[length.alias(c) if c == "n_chars" else quoted(saved.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: und, or a tie of two codewords."""
    model = langid.train(docs)
    return _aside(docs, ("lang_pred", "score", "ambiguous"), lambda d: langid.identify(d, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that stand earlier in the corpus, one or two lines by their content; a document of which nothing is left goes."""
    return _aside(docs, ("n_lines", "n_removed"), lambda d: linededup.dedup_lines(d, words=linededup.CONTENT)).where("trim(text) <> ''")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more. Candidates by SimHash fingerprints of two differing bits at most, and by MinHash bands, as SimHash segments are too short for all copies at 0.8."""
    return nearcopies.keep_first(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms."""
    return _aside(docs, ("n_pii",), lambda d: pii.pseudonymise(d, pii.application_key(spark)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pseudonyms", pseudonyms), ("best_fit_packing", best_fit_packing)]

#: Models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
