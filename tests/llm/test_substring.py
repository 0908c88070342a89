"""What splitting large groups of suffixes costs."""

import random

from lodeseek.llm import substring


def _shuffled(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_groups_are_split_without_shuffling_texts_again(spark):
    """The texts are shuffled once, whether groups are split or not; each split shuffled them twice more."""
    rng = random.Random(9)
    word = lambda: f"{rng.getrandbits(40):010x}"
    shared = [word() for _ in range(8)]
    texts = [" ".join([word() for _ in range(2000)] + shared + [word() for _ in range(60)]) for _ in range(60)]
    texts += [" ".join(t.split()[1000:1100]) for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, written = [], [_shuffled(spark)]
    for limit in (substring.LIMIT, 200):
        found.append(sorted(map(tuple, substring.dedup_substrings(docs, limit=limit).collect())))
        written.append(_shuffled(spark))
    assert found[0] == found[1] and sum(r[2] for r in found[0]) == 20 * 100
    assert written[2] - written[1] < 1.3 * (written[1] - written[0])


def test_few_files_are_written_between_the_steps(spark, monkeypatch):
    """Stretches are found anew rather than written, and what is written takes few files whatever the number of partitions: each file starts programs from the executor."""
    taken, was = [], substring.checkpoint
    monkeypatch.setattr(substring, "checkpoint", lambda df: taken.append(was(df)) or taken[-1])
    texts = [" ".join(f"w{k % 7}x{i}" for i in range(120)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = substring.dedup_substrings(docs).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r.n_removed for r in found) == 33 * 120
    most = max(4 * spark.sparkContext.defaultParallelism, 96 // 8)
    assert taken and all(df.rdd.getNumPartitions() <= most for df in taken)
    assert not any(df.count() > df.select("key", "h").distinct().count() for df in taken if "h" in df.columns)


def test_a_hot_signature_is_split(spark):
    """A group of most stretches is joined in several tasks: strings are dealt out anew after the join."""
    found = spark.range(40_000).selectExpr("if(id % 10 < 9, 5L, id) as key", "id % 1000 as h", "id as doc_id", "0L as _row_key", "1 as w0", "2 as n", "3 as size").repartition(8)
    shared = spark.createDataFrame([(5,), (7,)], "key long").repartition(2)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    kept = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        strings = substring._strings(found, shared)
        rows = strings.collect()
        plan = strings._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(rows) == 900 and {r.key for r in rows} == {5} and all(r.doc_id == r.h for r in rows)
    assert "skew=true" in plan
