"""Search plans: exact, pruned by clusters, by product quantisation, and by residual product quantisation.

All queries run in one job. Results are (query_id, doc_id, score, rank); only scored documents appear. Pruned
searches join blocks of a cluster's tokens with blocks of the queries that probe the cluster: a token is scored only
with queries that probe its cluster, and all tokens of a query see the same candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B
from . import quantize as Z
from . import shards as H
from .encode import Encoder, encode_queries
from .lazy import Lazy
from .scoring import maxsim_blocks, packed_scores, similarities, top_k


def search_bruteforce(tokens: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return top_k(maxsim_blocks(tokens, queries, k), k)


def search_packed(packed: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search_bruteforce of a corpus stored as packed_documents."""
    return top_k(packed_scores(packed, queries, k), k)


def search_chunked(tokens: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """tokens (doc_id, chunk_idx, vec) of overlapping chunks: the best token over all chunks of a document counts. Queries are augmented when they are encoded (encode_queries)."""
    return search_bruteforce(tokens, queries, k)


def search_texts(tokens: DataFrame, texts: DataFrame, k: int = 100, augment: bool = False, encoder: Encoder | Lazy | None = None) -> DataFrame:
    """The exact search for query texts (query_id, text): encoded, with augment padded by mask tokens, and scored against tokens (chunks of a document count together)."""
    return search_chunked(tokens, encode_queries(texts, encoder, augment=augment), k)


def exact_scores(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    return maxsim_blocks(tokens, queries)


def centroid_sim(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, q_tok, cluster_id, s) of all pairs."""
    rows = similarities(centroids.select(F.lit(0).alias("doc_id"), F.col("cluster_id").alias("token_id"), F.col("cvec").alias("vec")), queries, ("query_id", "q_tok", "token_id", "s"))
    return rows.select("query_id", "q_tok", F.col("token_id").cast("int").alias("cluster_id"), "s")


def probe_ranks(queries: DataFrame, centroids: DataFrame, most: int, shape: tuple[int, int | None] | None = None) -> DataFrame:
    """(query_id, q_tok, cluster_id, s, rank int): the ``most`` best clusters of each query token, ties to the smaller cluster_id. shape: that of the centroids, if it is known."""
    n, dim = shape or B.shape(centroids, "cvec")
    names = "query_id long, q_tok int, cluster_id int, s double"
    if dim is None:
        return queries.sparkSession.createDataFrame([], names + ", rank int")
    large = Z.query_blocks(queries, dim)
    small = B.pack(centroids.select(F.lit(0).cast("long"), F.col("cluster_id").cast("long").alias("id"), F.lit(0).cast("long"), V.doubles("cvec")).sortWithinPartitions("id"), dim)

    def run(pairs):
        kernel = B.Products(dim)
        for qids, qtoks, clusters, _, data, c in pairs:
            s = kernel.scores(data, len(qids), c)
            order = np.lexsort((np.broadcast_to(clusters, s.shape), -np.round(s, V.TIE_DIGITS)), axis=1)[:, :most]
            k = order.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, k)), pa.array(np.repeat(qtoks, k).astype(np.int32)), pa.array(clusters[order.ravel()].astype(np.int32)), pa.array(np.take_along_axis(s, order, axis=1).ravel())], names=["query_id", "q_tok", "cluster_id", "s"])

    best = B.Pairs(large, small, 8 * n * dim).apply(run, B.Products(dim), names)
    order = Window.partitionBy("query_id", "q_tok").orderBy(F.desc(F.round("s", V.TIE_DIGITS)), "cluster_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def probes(queries: DataFrame, centroids: DataFrame, most: int, shape: tuple[int, int | None] | None = None) -> DataFrame:
    """(query_id, cluster_id, rank): the clusters that any token of the query probes, with the least rank among its tokens. The union is by query."""
    return probe_ranks(queries, centroids, most, shape).groupBy("query_id", "cluster_id").agg(F.min("rank").alias("rank"))


def probed_clusters(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, cluster_id): what any token of the query probes."""
    return probes(queries, centroids, nprobe).select("query_id", "cluster_id")


def candidates(assigned: DataFrame, probed: DataFrame) -> DataFrame:
    """Tokens of the probed clusters, by query (and whatever else probed has)."""
    return assigned.join(probed, "cluster_id")


def _probing_blocks(probed: DataFrame, queries: DataFrame, centroids: DataFrame, dim: int, terms: bool) -> DataFrame:
    """Blocks of the queries that probe a cluster, by cluster. more: the query token's product with the centroid, or zero."""
    rows = probed.join(queries.select("query_id", "q_tok", V.doubles("qvec").alias("qvec")), "query_id")
    more = F.lit(0.0)
    if terms:
        rows = rows.join(centroids.select("cluster_id", V.doubles("cvec").alias("cvec")), "cluster_id")
        more = V.dot(F.col("qvec"), F.col("cvec"))
    sub = F.shiftleft(F.col("q_tok").cast("long"), 32) + F.col("rank")
    rows = rows.select(F.col("cluster_id").cast("long").alias("key"), F.col("query_id").cast("long").alias("id"), sub.alias("sub"), "qvec", more.alias("more"))
    return B.pack(rows.repartition("id").sortWithinPartitions("key", "id", "sub"), dim, B.QUERY_ROWS)


def _pruned(tokens: DataFrame, value: str, kernel: B.Products, packed: bool, queries: DataFrame, centroids: DataFrame, nprobe: int | None, terms: bool, shape: tuple[int, int | None]) -> DataFrame:
    """(query_id, doc_id, rank, best) of the tokens (doc_id, cluster_id, value) in the probed clusters. shape: that of the centroids. nprobe None: all clusters."""
    column = F.col(value) if packed else V.doubles(value)
    probed = probes(queries, centroids, nprobe or max(1, shape[0]), shape)
    # Clusters that no query probes are left out first: of a stored index their folders are not read. The list has an
    # entry for each cluster at most.
    if nprobe and 8 * shape[0] <= B.BROADCAST:
        tokens = tokens.join(F.broadcast(probed.select("cluster_id").distinct()), "cluster_id", "left_semi")
    rows = tokens.select(F.col("cluster_id").cast("long").alias("key"), F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("sub"), column.alias("value"))
    asked = _probing_blocks(probed, queries, centroids, kernel.dim, terms)
    large = B.pack(rows.sortWithinPartitions("key", "id"), None if packed else kernel.dim)
    return B.part_scores(B.of_key(large, asked), kernel)


def _search(tokens: DataFrame, value: str, kernel: B.Products, packed: bool, queries: DataFrame, centroids: DataFrame, nprobes: list[int | None], k: int, terms: bool, held: DataFrame | None = None) -> DataFrame:
    """(nprobe, query_id, doc_id, score) over the tokens (doc_id, cluster_id, value), or their shards where they are there already.

    Inside shards if queries and centroids may go to all executors; else blocks of a cluster's tokens meet blocks of its queries.
    """
    found = H.search(H.shards(tokens, value, None if packed else kernel.dim) if held is None else held, kernel, queries, centroids, nprobes, k, terms)
    if found is not None:
        return found
    most = None if None in nprobes else max(nprobes)
    if held is not None:
        tokens, value, packed = unpacked(held, kernel), "data", True
    parts = _pruned(tokens, value, kernel, packed, queries, centroids, most, terms, B.shape(centroids, "cvec"))
    each = F.explode(F.array(*[F.lit(n or 0).cast("int") for n in nprobes]))
    parts = parts.withColumn("nprobe", each).where((F.col("nprobe") == 0) | (F.col("rank") <= F.col("nprobe")))
    return B.combine(parts, ("nprobe",))


def unpacked(held: DataFrame, kernel: B.Products) -> DataFrame:
    """Shards of codes as rows (doc_id, cluster_id, data)."""

    def run(batches):
        for batch in batches:
            for ids, subs, data in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                rows = kernel.rows(data, len(ids) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(subs, np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "cluster_id", "data"])

    return B.arrow(held, run, "doc_id long, cluster_id long, data binary")


def search_ivf(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int = 8, k: int = 10) -> DataFrame:
    """assigned: (doc_id, cluster_id, vec)."""
    return top_k(_search(assigned, "vec", B.Products(B.width(centroids, "cvec") or 1), False, queries, centroids, [nprobe], k, False), k)


def search_stats(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, n_candidates, n_probed)."""
    probed = probed_clusters(queries, centroids, nprobe)
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return probed.join(sizes, "cluster_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"), F.count("*").alias("n_probed"))


def search_pq(codes: DataFrame, queries: DataFrame, codebooks: DataFrame, k: int = 100) -> DataFrame:
    """codes: (doc_id, codes binary)."""
    kernel = B.Lookups(Z.codebook_array(codebooks))
    rows = codes.select(F.lit(0).cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("sub"), "codes")
    large = B.pack(B.dealt(rows, "doc_id").sortWithinPartitions("doc_id"), None)
    return top_k(B.whole_scores(B.Pairs(large, Z.query_blocks(queries, kernel.dim), 8 * queries.count() * kernel.dim), kernel, k), k)


def search_ivf_pq(codes: DataFrame, queries: DataFrame, codebooks: DataFrame, centroids: DataFrame, nprobe: int = 8, k: int = 100, held: DataFrame | None = None) -> DataFrame:
    """codes: (doc_id, cluster_id, codes binary), or held: their shards."""
    return top_k(_search(codes, "codes", B.Lookups(Z.codebook_array(codebooks)), True, queries, centroids, [nprobe], k, False, held), k)


def search_residual_pq(codes: DataFrame, queries: DataFrame, codebooks: DataFrame, centroids: DataFrame, nprobe: int | None = None, k: int = 100, held: DataFrame | None = None) -> DataFrame:
    """codes and codebooks are those of the residuals. The centroid's part of a score is computed once for each probed cluster and query token. nprobe None: all clusters. held: the codes' shards.

    Over all clusters nothing is looked up by cluster: blocks of whole documents meet blocks of queries, as in search_pq, and a code carries
    the place of its centroid.
    """
    model = Z.centroid_matrix(centroids) if nprobe is None and held is None else None
    if model is not None:
        kernel = B.Residuals(Z.codebook_array(codebooks), model[1])
        value = F.concat(Z.centroid_place("cluster_id", model[0]), "codes")
        rows = codes.select(F.lit(0).cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("sub"), value.alias("value"))
        large = B.pack(B.dealt(rows, "doc_id").sortWithinPartitions("doc_id"), None)
        return top_k(B.whole_scores(B.Pairs(large, Z.query_blocks(queries, kernel.dim), 8 * queries.count() * kernel.dim), kernel, k), k)
    return top_k(_search(codes, "codes", B.Lookups(Z.codebook_array(codebooks)), True, queries, centroids, [nprobe], k, True, held), k)


def sweep_nprobe(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, nprobes: list[int], k: int = 10) -> DataFrame:
    """(nprobe, query_id, doc_id, score, rank) for all settings in one job: tokens are scored once, with the rank of their cluster, and each setting takes a prefix of the ranks."""
    return top_k(_search(assigned, "vec", B.Products(B.width(centroids, "cvec") or 1), False, queries, centroids, list(nprobes), k, False), k, by=("nprobe", "query_id"))


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) over single vectors (doc_id, vec) with one row each; queries (query_id, qvec). A vector is no neighbour of its own id."""
    n, dim = B.shape(queries, "qvec")
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    large = B.pack(vectors.select(F.lit(0).cast("long"), F.col("doc_id").cast("long"), F.lit(0).cast("long"), V.doubles("vec")), dim)
    small = Z.query_blocks(queries.withColumn("q_tok", F.lit(0)), dim)
    found = B.whole_scores(B.Pairs(large, small, 8 * n * dim), B.Products(dim), k + 1)
    return top_k(found.where("doc_id <> query_id"), k)
