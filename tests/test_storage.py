"""Builds in a shared warehouse."""

import __spark_entry__ as entry
from lodeseek.plans import queries as P
from lodeseek.sources import storage

DATA = "/root/testdata/sf0.001"


def test_a_build_beside_another_takes_nothing_from_its_readers(spark, tmp_path):
    """Another application finds no build, as this one's is not complete yet, and ends its own while this one is read."""
    path = f"{tmp_path}/store"

    def build(folder):
        spark.range(5).write.parquet(folder)

    def slow(folder):
        build(folder)
        first.append(spark.read.parquet(folder))
        mine = storage.complete
        storage.complete = lambda *_: None
        try:
            storage.built(spark, path, build)
        finally:
            storage.complete = mine

    first = []
    storage.built(spark, path, slow)
    assert first[0].count() == 5
    assert spark.read.parquet(storage.built(spark, path, build)).count() == 5


def test_half_a_build_is_not_read(spark, tmp_path):
    path = f"{tmp_path}/store"
    spark.range(5).write.parquet(f"{path}/0/centroids")
    assert storage.complete(spark, path, "meta") is None
    assert storage.built(spark, path, lambda folder: spark.range(1).write.parquet(f"{folder}/meta"), "meta") != f"{path}/0"


def test_stored_recall_while_its_index_is_built_again(spark, monkeypatch):
    """As where two applications run at once: the second builds while the first reads."""
    found = entry.queries()["stored_recall"](spark, DATA)
    monkeypatch.setattr(storage, "complete", lambda *_: None, raising=False)
    monkeypatch.setattr(storage, "exists", lambda *_: False)
    P._stored(spark, DATA, False)
    rows = found.collect()
    assert {r["kind"] for r in rows} == {"plain", "residual"} and all(0 <= r["recall"] <= 1 for r in rows)
