"""First-seen texts of a stream against the batch operators, in any split into batches and over a restart."""

import json
import os
import random

from pyspark.sql import functions as F

from lodeseek.operators import text as C
from lodeseek.streaming import unique


def write(folder, number, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{number}.json"
    path.write_text("\n".join(json.dumps({"doc_id": i, "passages": {"passage_text": t}}) for i, t in rows))
    os.utime(path, (1_700_000_000 + number,) * 2)  # files arrive by time


def test_unique_texts_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.choice("abcdefghij") * rng.randint(1, 3) if rng.random() < 0.95 else None for _ in range(rng.randint(0, 5))]) for i in range(40)]
    flat = spark.createDataFrame([(i * (1 << 20) + k, t) for i, ts in rows for k, t in enumerate(ts) if t is not None], "doc_id long, text string")
    want = sorted(map(tuple, C.dedup_first(flat).collect()))
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    for number, (a, b) in enumerate([(0, 7), (7, 8), (8, 25)]):
        write(source, number, rows[a:b])
    unique.collect_unique(unique.nested_passages(spark, str(source)), target, progress)
    early = sorted(map(tuple, unique.unique_texts(spark, target, 1000).collect()))
    assert early == [w for w in want if w[0] < 25 << 20]
    write(source, 3, rows[25:])
    unique.collect_unique(unique.nested_passages(spark, str(source)), target, progress)
    found = spark.read.parquet(target)
    assert sorted(map(tuple, found.select("doc_id", "text").collect())) == want  # nothing comes twice
    few = unique.unique_texts(spark, target, 5).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, C.limit_unique(flat, 5).collect())) == want[:5]


def test_a_stream_ends_when_enough_is_there(spark, tmp_path):
    source = tmp_path / "in"
    for number in range(12):
        write(source, number, [(number, [f"text {number} {k}" for k in range(4)])])
    query = unique.collect_unique(unique.nested_passages(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "progress"), most=6)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert not query.isActive and 6 <= found.count() < 48 and found.agg(F.count_distinct("text")).first()[0] == found.count()
    assert [r["text"] for r in unique.unique_texts(spark, str(tmp_path / "out"), 6).orderBy("doc_id").collect()] == [f"text {i} {k}" for i in range(2) for k in range(4)][:6]
