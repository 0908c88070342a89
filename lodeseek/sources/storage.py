"""Corpora, indexes and reports as plain Parquet and JSON folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_TABLES = ("centroids", "codebooks", "codes", "meta")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Nested rows {passages: {passage_text: [...]}} as (text)."""
    return spark.read.schema("passages struct<passage_text: array<string>>").json(path).select(F.explode("passages.passage_text").alias("text"))


def read_benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, queries, qrels) from JSON lines."""
    docs = spark.read.schema("doc_id string, title string, text string").json(f"{folder}/docs")
    queries = spark.read.schema("query_id string, text string").json(f"{folder}/queries")
    return docs, queries, spark.read.schema("query_id string, doc_id string, relevance int").json(f"{folder}/qrels")


def write_corpus(tokens: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").parquet(path)


def write_settings(spark: SparkSession, path: str, **settings: int) -> None:
    spark.createDataFrame([(k, int(v)) for k, v in settings.items()], "name string, value long").write.mode("overwrite").parquet(f"{path}/meta")


def write_index(path: str, centroids: DataFrame, codebooks: DataFrame, codes: DataFrame, **settings: int) -> None:
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    codebooks.write.mode("overwrite").parquet(f"{path}/codebooks")
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    write_settings(codes.sparkSession, path, **settings)


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES}


def _path(spark: SparkSession, path: str):
    """(path, file system) of Hadoop, which knows every store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder, written or still to be written, deleted when the application ends."""
    target, system = _path(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time) of a table's files: what tells one state of it from another without a read."""
    target, system = _path(spark, path)
    found = system.listStatus(target)
    return sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found if not f.getPath().getName().startswith(("_", ".")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is complete, in any file system that Spark reads."""
    target, system = _path(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def complete(spark: SparkSession, path: str, mark: str = "") -> str | None:
    """The first complete one of the builds in a folder, each in a folder of its own; mark names the part that is written last."""
    target, system = _path(spark, path)
    if not system.exists(target):
        return None
    names = sorted(f.getPath().getName() for f in system.listStatus(target) if f.isDirectory())
    return next((f"{path}/{n}" for n in names if exists(spark, f"{path}/{n}/{mark}".rstrip("/"))), None)


def built(spark: SparkSession, path: str, build: Callable[[str], None], mark: str = "") -> str:
    """The folder of a complete build under path, made by ``build(folder)`` if there is none.

    Applications that share a warehouse may build at the same time: each writes to a folder of its own, and nothing that another one
    may be reading is ever overwritten.
    """
    found = complete(spark, path, mark)
    if found is None:
        found = f"{path}/{uuid.uuid4().hex}"
        build(found)
    return found


def build_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame], **options) -> DataFrame:
    return spark.read.parquet(built(spark, path, lambda folder: build().write.options(**options).parquet(folder)))


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def append_history(metrics: DataFrame, path: str, **tags: str) -> None:
    for name, value in tags.items():
        metrics = metrics.withColumn(name, F.lit(value))
    metrics.withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode("append").json(path)
