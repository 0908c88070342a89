"""Incremental indexing: new texts are encoded, assigned to clusters, coded and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import encode, quantize
from ..operators.encode import Encoder
from ..operators.lazy import Lazy


def index_batch(docs: DataFrame, centroids: DataFrame, codebooks: DataFrame, encoder: Encoder | Lazy | None = None) -> DataFrame:
    """(doc_id, text) -> (token_id, doc_id, cluster_id, codes): token_id is doc_id * 2**20 + position, so batches need no common counter. The residuals are coded."""
    dim = B.width(centroids, "cvec")
    tokens = encode.encode_docs(docs, encoder or encode.HashEncoder(dim)).withColumn("token_id", F.col("doc_id") * (1 << 20) + F.col("pos"))
    near = quantize.assign_nearest(tokens.select("token_id", "doc_id", "vec"), centroids)
    return quantize.encode_codes(near, codebooks, centroids).select("token_id", "doc_id", "cluster_id", "codes")


def stream_index(spark: SparkSession, source: str, target: str, progress: str, centroids: DataFrame, codebooks: DataFrame, encoder: Encoder | Lazy | None = None):
    """A query that reads Parquet files (doc_id, text) as they come and writes each batch to its own folder below target, so that a repeated batch replaces itself."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        index_batch(batch, centroids, codebooks, encoder).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
