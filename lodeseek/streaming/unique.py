"""First-seen texts of a stream: nested passages are flattened as they arrive, and each distinct text passes once, whenever it comes again."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.text import limit_unique


def nested_passages(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream (doc_id, text) of JSON rows {doc_id, passages: {passage_text: [...]}}, ``files`` files at a time; a passage's id is 2**20 times its row's, and its place."""
    rows = spark.readStream.schema("doc_id long, passages struct<passage_text: array<string>>").option("maxFilesPerTrigger", files).json(path)
    return rows.select("doc_id", F.posexplode("passages.passage_text").alias("_at", "text")).select((F.col("doc_id") * (1 << 20) + F.col("_at")).alias("doc_id"), "text")


def first_seen(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a stream -> its rows whose text has not come before: of a batch the one with the smallest id. Null texts and ids are left out.

    The state has the digest of each distinct text and the id that it came with, dealt out over the partitions of the shuffle.
    """

    def seen(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            row = frame.loc[frame["doc_id"].idxmin()]
            if best is None or row["doc_id"] < best["doc_id"]:
                best = row
        if not state.exists and best is not None:
            state.update((int(best["doc_id"]),))
            yield pd.DataFrame({"doc_id": [int(best["doc_id"])], "text": [best["text"]]})

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", F.sha2("text", 256).alias("_k"))
    return rows.groupBy("_k").applyInPandasWithState(seen, "doc_id long, text string", "first long", "append", GroupStateTimeout.NoTimeout)


def collect_unique(docs: DataFrame, target: str, progress: str, most: int | None = None) -> StreamingQuery:
    """Runs a stream (doc_id, text) until it is read, or ``most`` distinct texts are there, and has it end; what it found is read by ``unique_texts``.

    Each batch has a folder of its own below target, so that a batch that is run again after a failure replaces itself; a later run
    with the same progress folder goes on where this one ended and repeats nothing.
    """
    enough = threading.Event()

    def write(batch: DataFrame, number: int) -> None:
        if enough.is_set():
            return
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if most is not None and batch.sparkSession.read.parquet(target).count() >= most:
            enough.set()

    query = first_seen(docs).writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    while query.isActive and not enough.wait(0.2):
        pass
    if enough.is_set():
        query.stop()  # a batch that has begun leaves nothing, as its files are not committed
    else:
        query.awaitTermination()  # raises what made it fail
    return query


def unique_texts(spark: SparkSession, target: str, most: int) -> DataFrame:
    """(doc_id, text): the ``most`` first ones of what collect_unique has written, by id."""
    return limit_unique(spark.read.schema("doc_id long, text string").parquet(target), most)
