"""Similarity joins and late-interaction scoring: for each query token the best document token, summed over the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B
from .quantize import query_blocks

_PAIRS = "query_id long, q_tok int, doc_id long, token_id long, s double"


def _zero():
    return F.lit(0).cast("long")


def similarities(tokens: DataFrame, queries: DataFrame, columns: tuple[str, ...] = ("query_id", "q_tok", "doc_id", "token_id", "s"), digits: int | None = None) -> DataFrame:
    """(query_id, q_tok, doc_id, token_id, s) of all pairs, or some of these columns; s is rounded to ``digits``."""
    n, dim = B.shape(queries, "qvec")
    if dim is None:
        return tokens.sparkSession.createDataFrame([], _PAIRS).select(*columns)
    large = B.pack(tokens.select(_zero(), F.col("doc_id").cast("long"), F.col("token_id").cast("long"), V.doubles("vec")), dim)
    return B.all_scores(B.Pairs(B.dealt(large), query_blocks(queries, dim), 8 * n * dim), B.Products(dim), columns, digits)


def distances(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """(token_id, cluster_id, d) of all pairs: squared distances."""
    n, dim = B.shape(centroids, "cvec")
    large = B.pack(tokens.select(_zero(), F.col("token_id").cast("long"), _zero(), V.doubles("vec")), dim)
    small = query_blocks(centroids.select(F.col("cluster_id").alias("query_id"), F.lit(0).alias("q_tok"), F.col("cvec").alias("qvec")), dim)
    rows = B.all_scores(B.Pairs(B.dealt(large), small, 8 * n * dim), B.Distances(dim), ("query_id", "doc_id", "s"))
    return rows.select(F.col("doc_id").alias("token_id"), F.col("query_id").cast("int").alias("cluster_id"), F.col("s").alias("d"))


def maxsim(scores: DataFrame, by: tuple[str, ...] = ("query_id",), doc: str = "doc_id") -> DataFrame:
    """(by..., doc, q_tok, s) -> (by..., doc, score): the greatest s of each query token, summed. Both steps combine map-side."""
    best = scores.groupBy(*by, doc, "q_tok").agg(F.max("s").alias("s"))
    return best.groupBy(*by, doc).agg(F.sum("s").alias("score"))


def packed_documents(tokens: DataFrame, dim: int, single: bool = False) -> DataFrame:
    """Blocks of whole documents: tokens come together by document in one shuffle. Written to storage, a corpus is searched without any. single: in single precision, half as large and twice as fast."""
    rows = tokens.select(_zero().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), _zero().alias("sub"), V.doubles("vec"))
    return B.pack(rows.repartition("doc_id").sortWithinPartitions("doc_id"), dim, single=single)


def packed_scores(packed: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of packed_documents. A score is complete where it is computed, and with k a task gives only the rows that may be among a query's k best."""
    n, dim = B.shape(queries, "qvec")
    if dim is None:
        return packed.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    return _packed_scores(packed, queries, n, dim, k)


def _packed_scores(packed: DataFrame, queries: DataFrame, n: int, dim: int, k: int | None) -> DataFrame:
    return B.whole_scores(B.Pairs(packed, query_blocks(queries, dim), 8 * n * dim), B.Products(dim), k)


def maxsim_blocks(tokens: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """maxsim(similarities(...)) as (query_id, doc_id, score), by products of blocks."""
    n, dim = B.shape(queries, "qvec")
    if dim is None:
        return tokens.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    return _packed_scores(packed_documents(tokens, dim), queries, n, dim, k)


def max_over_chunks(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """tokens (doc_id, chunk_idx, vec) -> (query_id, doc_id, score): the best chunk's score, a chunk scored by itself. A document has fewer than 2^20 chunks."""
    chunks = tokens.withColumn("doc_id", F.col("doc_id") * (1 << 20) + F.col("chunk_idx"))
    scores = maxsim_blocks(chunks, queries)
    return scores.groupBy("query_id", F.shiftright("doc_id", 20).alias("doc_id")).agg(F.max("score").alias("score"))


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), doc: str = "doc_id", digits: int = B.DIGITS) -> DataFrame:
    """The k best documents of each query with rank int from 1; ties of the rounded score go to the smaller id. Fewer than k scored documents give fewer rows."""
    rows = scores.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), doc)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, doc, "score", "rank")
