"""The test tables as retrieval inputs: each vector of ``embeddings`` is a token, five in a row a document.

Queries are the five tokens of every tenth document, so their number grows with the table; so does the number of
clusters, with its square root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import quantize as Z
from ..operators.evaluate import Labels
from ..sources.storage import read_table

DIM, M, CODES, PER_DOC, PER_QUERY = 64, 8, 16, 5, 50
NPROBES = [1, 2, 4, 8, 16]
#: Shares that the documents of a label are dealt out to.
SALTS = 32


def div(a: str, b: int) -> Column:
    return F.floor(F.col(a) / b).cast("long")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return e.select(F.col("vec_id").alias("token_id"), div("vec_id", PER_DOC).alias("doc_id"), (F.col("vec_id") % PER_DOC).cast("int").alias("pos"), V.doubles("embedding").alias("vec"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf).where(F.col("vec_id") % PER_QUERY < PER_DOC)
    return e.select(div("vec_id", PER_QUERY).alias("query_id"), (F.col("vec_id") % PER_QUERY).cast("int").alias("q_tok"), V.doubles("embedding").alias("qvec"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """About the square root of the number of vectors, evenly spaced by vec_id."""
    return spaced(spark, sf, math.ceil(math.sqrt(embeddings(spark, sf).count())))


def spaced(spark: SparkSession, sf: str, step: int) -> DataFrame:
    """Every ``step``-th vector as a centroid."""
    e, step = embeddings(spark, sf), max(1, step)
    return e.where(F.col("vec_id") % step == 0).select(div("vec_id", step).cast("int").alias("cluster_id"), V.doubles("embedding").alias("cvec"))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return Z.assign_nearest(tokens(spark, sf), centroids(spark, sf))


def codeword(spark: SparkSession, sf: str) -> Column:
    """Numbers the tokens whose parts are codewords: as many as CODES, evenly spaced."""
    step = max(1, embeddings(spark, sf).count() // CODES)
    return F.when((F.col("token_id") % step == 0) & (F.col("token_id") < CODES * step), div("token_id", step))


def codebooks(spark: SparkSession, sf: str, m: int = M) -> DataFrame:
    return Z.seed_codebooks(tokens(spark, sf), codeword(spark, sf), m, DIM)


def residual_codebooks(spark: SparkSession, sf: str) -> DataFrame:
    return Z.seed_codebooks(Z.residuals(assigned(spark, sf), centroids(spark, sf)), codeword(spark, sf), M, DIM)


def codes(spark: SparkSession, sf: str, m: int = M) -> DataFrame:
    return Z.encode_codes(assigned(spark, sf), codebooks(spark, sf, m))


def residual_codes(spark: SparkSession, sf: str) -> DataFrame:
    return Z.encode_codes(assigned(spark, sf), residual_codebooks(spark, sf), centroids(spark, sf))


def labels(spark: SparkSession, sf: str) -> Labels:
    """The least label of each document and of each query; a document is relevant to the queries of its label."""
    e = embeddings(spark, sf)
    q = e.where(F.col("vec_id") % PER_QUERY < PER_DOC).groupBy(div("vec_id", PER_QUERY).alias("query_id")).agg(F.min("label").alias("label"))
    return Labels(e.groupBy(div("vec_id", PER_DOC).alias("doc_id")).agg(F.min("label").alias("label")), q)


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """A document is judged for a query if its least label is that of the query (relevance 1) or the next one (0).

    All pairs, which grow with the square of the table. There are ten labels only: a label's queries come together in lists of some
    thousand, and documents, dealt out evenly, meet lists, so that no task gets all documents of a label.
    """
    held = labels(spark, sf)
    label = F.col("label")
    graded = held.queries.select("query_id", F.explode(F.array(F.struct(label.alias("dl"), F.lit(1).alias("relevance")), F.struct(((label + 1) % 10).alias("dl"), F.lit(0).alias("relevance")))).alias("g")).select("query_id", "g.*")
    lists = graded.groupBy("dl", "relevance", F.floor(F.col("query_id") / 10_000).alias("_part")).agg(F.collect_list("query_id").alias("_q"))
    docs = held.docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.join(lists, (F.col("label") == F.col("dl")) & (docs["_salt"] == lists["_salt"]))
    return rows.select(F.explode("_q").alias("query_id"), "doc_id", "relevance").select("query_id", "doc_id", "relevance")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")
