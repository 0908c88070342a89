"""Trained indexes on storage: centroids and codebooks are trained, tokens assigned, coded and written as shards of whole documents, which searches read as they are."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..sources import storage
from . import blocks as B
from . import quantize as Z
from . import search as Q
from . import shards as H


def build_index(tokens: DataFrame, path: str, clusters: int, m: int, codewords: int = 256, residual: bool = True, seed: int = 42) -> None:
    """tokens (token_id, doc_id, vec): k-means, assignment, codebooks of the vectors or of their residuals, codes; each model is written before it is used."""
    spark, dim = tokens.sparkSession, B.width(tokens, "vec")
    if dim is None:
        raise ValueError("an index needs vectors")
    Z.kmeans_train(tokens, clusters, seed).write.mode("overwrite").parquet(f"{path}/centroids")
    centroids = spark.read.parquet(f"{path}/centroids")
    assigned = Z.assign_nearest(tokens.select("token_id", "doc_id", "vec"), centroids)
    # Training passes over the residuals again and again: they are kept on the executors' disks meanwhile, and made anew where one is lost.
    left = (Z.residuals(assigned, centroids) if residual else assigned).select("token_id", "vec").persist(StorageLevel.DISK_ONLY)
    Z.pq_train(left, m, codewords, dim, seed).write.mode("overwrite").parquet(f"{path}/codebooks")
    left.unpersist()
    codebooks = spark.read.parquet(f"{path}/codebooks")
    codes = Z.encode_codes(assigned, codebooks, centroids if residual else None)
    H.shards(codes, "codes", None).write.mode("overwrite").parquet(f"{path}/codes")
    storage.write_settings(spark, path, dim=dim, m=m, clusters=clusters, codewords=codewords, residual=int(residual))


def write_index(path: str, centroids: DataFrame, codebooks: DataFrame, codes: DataFrame, **settings: int) -> None:
    """An index of given parts: models as rows, codes (doc_id, cluster_id, codes) as shards of whole documents."""
    storage.write_index(path, centroids, codebooks, H.shards(codes, "codes", None), **settings)


def search_index(spark: SparkSession, path: str, queries: DataFrame, nprobe: int = 8, k: int = 100) -> DataFrame:
    """(query_id, doc_id, score, rank) from a stored index: tasks read its shards and score what lies in probed clusters."""
    index = storage.read_index(spark, path)
    settings = {r["name"]: r["value"] for r in index["meta"].collect()}
    search = Q.search_residual_pq if settings["residual"] else Q.search_ivf_pq
    return search(None, queries, index["codebooks"], index["centroids"], nprobe, k, index["codes"])
