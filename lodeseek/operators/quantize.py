"""Coarse clusters, product quantisation and residual product quantisation.

Clusters and codes are assigned by Euclidean distance, while clusters are probed and tokens scored by inner product.
Assigning and coding keep a token where it is: a batch of vectors is held against the whole model in one product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B
from . import train


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(cluster ids, matrix) in order of cluster_id; None if the matrix has more bytes than a table may have that goes to all executors."""
    n, dim = B.shape(centroids, "cvec")
    if n * (dim or 0) * 8 > B.BROADCAST:
        return None
    rows = centroids.select("cluster_id", V.doubles("cvec").alias("cvec")).orderBy("cluster_id").collect()
    return np.array([r["cluster_id"] for r in rows], dtype=np.int32), np.array([r["cvec"] for r in rows], dtype=np.float64).reshape(n, dim or 0)


def codebook_array(codebooks: DataFrame) -> np.ndarray:
    """(parts, codewords, components) of codebooks (m, k, cvec): 256 codewords a part at most, so its size is that of 256 vectors."""
    rows = codebooks.select("m", "k", V.doubles("cvec").alias("cvec")).orderBy("m", "k").collect()
    parts, words = len({r["m"] for r in rows}), len({r["k"] for r in rows})
    if not rows or words > 256 or [(r["m"], r["k"]) for r in rows] != [(m, k) for m in range(parts) for k in range(words)]:
        raise ValueError("codebooks must have the same codewords, 1 to 256 from 0, in each part from 0")
    return np.array([r["cvec"] for r in rows], dtype=np.float64).reshape(parts, words, -1)


def assign_nearest(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """tokens (vec, ...) with cluster_id int of the nearest centroid, ties to the smaller cluster_id. Tokens without a complete vector are left out."""
    model = centroid_matrix(centroids)
    tokens = tokens.drop("cluster_id")
    if model is None:
        return _assign_by_blocks(tokens, centroids)
    ids, matrix = model

    def run(batches):
        for batch in B._slices(batches):
            x, at = B.dense(batch.column(batch.schema.get_field_index("vec")).cast(pa.list_(pa.float64())), matrix.shape[1])
            if len(x) and len(ids):
                near, _ = B.nearest(x, matrix, V.TIE_DIGITS)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array(ids[near])], names=[*batch.schema.names, "cluster_id"])

    return B.arrow(tokens, run, B.appended(tokens, "cluster_id int"))


def _assign_by_blocks(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """assign_nearest for tokens with a token_id and more centroids than one task should hold: blocks against blocks, and the least over all of them."""
    n, dim = B.shape(centroids, "cvec")
    large = B.pack(tokens.select(F.lit(0).cast("long"), "token_id", F.lit(0).cast("long"), V.doubles("vec")), dim)
    small = B.pack(centroids.select(F.lit(0).cast("long"), F.col("cluster_id").cast("long"), F.lit(0).cast("long"), V.doubles("cvec")).sortWithinPartitions("cluster_id"), dim)

    def run(pairs):
        for ids, _, clusters, _, data, c in pairs:
            near, d = B.nearest(np.frombuffer(data).reshape(len(ids), dim), c, V.TIE_DIGITS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(d), pa.array(clusters[near].astype(np.int32))], names=["token_id", "d", "cluster_id"])

    found = B.Pairs(large, small, 8 * n * dim).apply(run, B.Products(dim), "token_id long, d double, cluster_id int")
    least = found.groupBy("token_id").agg(F.min(F.struct("d", "cluster_id")).alias("b")).select("token_id", "b.cluster_id")
    return tokens.join(least, "token_id").select(*tokens.columns, "cluster_id")


def with_centroid(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """assigned with cvec, the vector of its cluster."""
    return assigned.join(centroids.select("cluster_id", V.doubles("cvec").alias("cvec")), "cluster_id")


def residuals(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """assigned with what its cluster's centroid leaves of vec."""
    return with_centroid(assigned, centroids).withColumn("vec", V.subtract(F.col("vec"), F.col("cvec"))).drop("cvec")


def posting_lists(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, token_ids array sorted): empty clusters keep an empty list. A list is one row; searches read the assigned tokens themselves, by cluster."""
    lists = assigned.groupBy("cluster_id").agg(F.sort_array(F.collect_list("token_id")).alias("token_ids"))
    return centroids.select("cluster_id").join(lists, "cluster_id", "left").select("cluster_id", F.coalesce("token_ids", F.array().cast("array<long>")).alias("token_ids"))


def cluster_sizes(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return centroids.select("cluster_id").join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).alias("size"))


def parts(tokens: DataFrame, m: int, dim: int) -> DataFrame:
    """(token_id, m int, part array): each vector cut into m equal parts."""
    size = V.check_parts(dim, m)
    return tokens.select("token_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("m")).select("token_id", "m", V.subvector(F.col("vec"), F.col("m"), size).alias("part"))


def encode_codes(tokens: DataFrame, codebooks: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """tokens (vec, ...) with codes binary, one byte for each part, and error double in place of vec.

    A code names the nearest codeword, ties to the smaller code; error is the distance of the vector from its codewords.
    With centroids (of tokens with a cluster_id) the residuals are coded. Tokens without a complete vector are left out.
    """
    books = codebook_array(codebooks)
    model = centroid_matrix(centroids) if centroids is not None else None
    if centroids is not None and model is None:
        return encode_codes(residuals(tokens, centroids), codebooks)
    columns = [c for c in tokens.columns if c != "vec"]

    def run(batches):
        for batch in B._slices(batches):
            x, at = B.dense(batch.column(batch.schema.get_field_index("vec")).cast(pa.list_(pa.float64())), books.shape[0] * books.shape[2])
            rows = pa.array(at)
            rest = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in columns]
            if model is not None:
                x = x - model[1][np.searchsorted(model[0], rest[columns.index("cluster_id")].to_numpy())]
            near = [B.nearest(part, book, V.TIE_DIGITS) for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)]
            codes = np.stack([k for k, _ in near], axis=1).astype(np.uint8)
            error = np.sqrt(sum(d for _, d in near))
            yield pa.RecordBatch.from_arrays([*rest, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)], names=[*columns, "codes", "error"])

    kept = tokens.select(*columns)
    return B.arrow(tokens, run, B.appended(kept, "codes binary, error double"))


def code_list(codes: Column) -> Column:
    """Packed codes as array<smallint>."""
    return F.transform(F.sequence(F.lit(1), F.length(codes)), lambda i: F.conv(F.hex(F.substring(codes, i, F.lit(1))), 16, 10).cast("smallint"))


def pq_encode(tokens: DataFrame, codebooks: DataFrame) -> DataFrame:
    """(token_id, m int, k smallint): the nearest codeword of each part."""
    return transpose_codes(encode_codes(tokens, codebooks)).select("token_id", "m", F.col("code").alias("k"))


def transpose_codes(coded: DataFrame) -> DataFrame:
    """(m, token_id, code): the packed codes by part."""
    return coded.select("token_id", F.posexplode(code_list(F.col("codes"))).alias("m", "code")).select("m", "token_id", "code")


def lookup_scores(coded: DataFrame, queries: DataFrame, codebooks: DataFrame, columns: tuple[str, ...] = ("query_id", "q_tok", "doc_id", "token_id", "s"), digits: int | None = None) -> DataFrame:
    """coded (token_id, doc_id, codes) -> (query_id, q_tok, doc_id, token_id, s), or some of these columns: the summed table entries of every token for every query token, rounded to ``digits``."""
    kernel = B.Lookups(codebook_array(codebooks))
    large = B.pack(coded.select(F.lit(0).cast("long"), "doc_id", "token_id", "codes"), None)
    return B.all_scores(B.Pairs(B.dealt(large), query_blocks(queries, kernel.dim), 8 * queries.count() * kernel.dim), kernel, columns, digits)


def centroid_scores(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, columns: tuple[str, ...] = ("query_id", "q_tok", "token_id", "s"), digits: int | None = None) -> DataFrame | None:
    """assigned (token_id, cluster_id) -> (query_id, q_tok, token_id, s), or some of these columns: the product of every query token with every token's centroid. None if the centroids are more than may go to all tasks."""
    model = centroid_matrix(centroids)
    n, dim = B.shape(queries, "qvec")
    if model is None or dim is None:
        return None
    rows = assigned.select(F.lit(0).cast("long"), F.col("cluster_id").cast("long"), F.col("token_id").cast("long"), centroid_place("cluster_id", model[0]))
    return B.all_scores(B.Pairs(B.dealt(B.pack(rows, None)), query_blocks(queries, dim), 8 * n * dim), B.Shared(model[1]), columns, digits)


def centroid_place(cluster: str, ids: np.ndarray) -> Column:
    """The place of a cluster among the ids, ascending and distinct, as four bytes; null if it is not there."""
    place = F.array_position(F.lit(ids.tolist()), F.col(cluster).cast("int")) - 1
    if np.array_equal(ids, np.arange(len(ids))):
        place = F.col(cluster).cast("long")
    return F.when(place.between(0, len(ids) - 1), F.unhex(F.lpad(F.hex(place), 8, "0")))


def query_blocks(queries: DataFrame, dim: int) -> DataFrame:
    """Blocks of whole queries (query_id, q_tok, qvec)."""
    rows = queries.select(F.lit(0).cast("long").alias("key"), F.col("query_id").cast("long").alias("query_id"), F.col("q_tok").cast("long").alias("q_tok"), V.doubles("qvec"))
    return B.pack(rows.repartition("query_id").sortWithinPartitions("query_id", "q_tok"), dim, B.QUERY_ROWS)


# Training


def kmeans_train(tokens: DataFrame, k: int, seed: int = 42, passes: int = train.PASSES) -> DataFrame:
    """Trained (cluster_id int, cvec) over all vectors (token_id, vec). Fewer clusters where there are fewer distinct vectors."""
    dim = B.width(tokens, "vec")
    centroids = train.fit(tokens, 1, k, dim, seed, passes)[0][0] if dim else []
    return tokens.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster_id int, cvec array<double>")


def lloyd_step(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """One exact step: means of the assigned vectors by component; a cluster without vectors keeps its centroid."""
    near = assign_nearest(tokens, centroids)
    means = near.select("cluster_id", F.posexplode("vec").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    new = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("new"))
    return centroids.join(new, "cluster_id", "left").select("cluster_id", F.coalesce("new", "cvec").alias("cvec"))


def pq_train(tokens: DataFrame, m: int, k: int, dim: int, seed: int = 42, passes: int = train.PASSES) -> DataFrame:
    """(m int, k int, cvec, error): k-means of each part over all vectors, the parts side by side. error is the part's mean distance from its codewords.

    A part with fewer distinct values than others repeats its last codeword, so that all parts have as many.
    """
    V.check_parts(dim, m)
    if not 0 < k <= 256:
        raise ValueError("codes are one byte: 1 to 256 codewords")
    books = train.fit(tokens, m, k, dim, seed, passes)
    most = max(len(c) for c, _ in books)
    rows = [(part, i, c[min(i, len(c) - 1)].tolist(), error) for part, (c, error) in enumerate(books) for i in range(most)]
    return tokens.sparkSession.createDataFrame(rows, "m int, k int, cvec array<double>, error double")


def seed_codebooks(tokens: DataFrame, ids: Column, m: int, dim: int) -> DataFrame:
    """Codebooks (m, k, cvec) from the parts of chosen vectors. ids: a column expression that numbers the chosen tokens from 0 (null: not chosen)."""
    chosen = tokens.withColumn("_k", ids).where("_k is not null")
    return parts(chosen.select(F.col("_k").alias("token_id"), "vec"), m, dim).select("m", F.col("token_id").cast("int").alias("k"), F.col("part").alias("cvec"))
