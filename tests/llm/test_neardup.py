"""The near copies' SimHash step, and the number of jobs that components take."""

from pyspark.sql import functions as F

from lodeseek.llm import components, linededup, nearcopies, simhash


def test_simhash_pairs_are_all_within_two_bits(spark):
    base = 0x0F0F_3333_5555_00FF
    fps = [base, base, base ^ 1, base ^ (1 << 40) ^ 1, base ^ (1 << 40) ^ (1 << 9) ^ (1 << 3), base ^ 0b111, 0]
    sizes = [100, 100, 100, 90, 100, 100, 30]
    nodes = spark.createDataFrame([(i, n, fp) for i, (n, fp) in enumerate(zip(sizes, fps, strict=True))], "node long, n long, fp long")
    found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in nearcopies._simhash_pairs(nodes).collect()}
    # Of equal fingerprints the first node stands for the others.
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])
    want = {(0, 1)} | {(i, j) for j in range(7) for i in range(j) if 1 not in (i, j) and near(i, j)}
    assert found == want and len(want) > 3


def test_stars_settle_without_a_pass_to_see_that_nothing_changes(spark):
    edges = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(100, i) for i in range(101, 120)], "u long, v long")
    passes, step = [], components._large_star
    components._large_star = lambda e: (passes.append(1), step(e))[1]
    try:
        got = dict(map(tuple, components.components(edges).collect()))
        assert not passes and got == {**{i: 1 for i in range(1, 40)}, **{i: 100 for i in range(100, 120)}}
        chain = spark.createDataFrame([(i, i + 1) for i in range(200, 230)] + [(5, 5)], "u long, v long")
        assert dict(map(tuple, components.components(chain).collect())) == {i: 200 for i in range(200, 231)} and passes
    finally:
        components._large_star = step
    assert components.components(edges.where("u < 0")).isEmpty()


def test_components_make_few_tasks(spark):
    """A chain of 31 nodes beside a star: least neighbours also tell whether the steps are done, and edges are made distinct once a round."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200, 230)] + [(1, i) for i in range(2, 40)], "u long, v long").repartition(4).cache()
    edges.count()
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("chain", "components")
    try:
        found = dict(map(tuple, components.components(edges).collect()))
        jobs = tracker.getJobIdsForGroup("chain")
    finally:
        sc._jsc.clearJobGroup()
        edges.unpersist()
    assert found == {**{i: 200 for i in range(200, 231)}, **{i: 1 for i in range(1, 40)}}
    assert len(jobs) <= 80, len(jobs)


def test_what_verified_pairs_connect_is_gone_through_once(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[:-2]), " ".join(words[::-1]), "alone"]
    called, real = [], nearcopies.components
    nearcopies.components = lambda e: (called.append(e), real(e))[1]
    try:
        found = dict(map(tuple, nearcopies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    finally:
        nearcopies.components = real
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4} and len(called) == 1


def _planned(module, monkeypatch) -> list[str]:
    """The plans of what a module writes between its steps."""
    plans, real = [], module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    return plans


def test_groups_of_fingerprints_do_not_go_through_the_driver(spark, monkeypatch, tmp_path):
    """A few fingerprints make 66 times as many rows of the index, and the planner takes them to be as few."""
    spark.createDataFrame([(k * 0x0102_0408_1122_3344 ^ (1 << b),) for k in range(1, 40) for b in range(3)], "fp long").write.parquet(str(tmp_path / "fps"))
    plans = _planned(simhash, monkeypatch)
    links = simhash.fingerprint_links(spark.read.parquet(str(tmp_path / "fps")))
    assert links.count() == 39 * 3
    assert len(plans) == 2 and not [p for p in plans if "Broadcast" in p]


def test_bands_and_lines_do_not_go_through_the_driver(spark, monkeypatch, tmp_path):
    texts = ["\n".join(f"w{i // 4}x{k} a b c" for k in range(60 + i % 4)) for i in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, plans = spark.read.parquet(str(tmp_path / "docs")), [_planned(m, monkeypatch) for m in (nearcopies, linededup)]
    linededup.dedup_lines(docs).count()
    monkeypatch.setattr(nearcopies, "components", lambda edges: edges.select("u", F.least("u", "v").alias("m")).toDF("id", "component_id").limit(0))
    nearcopies.groups(docs)
    assert all(plans) and not [p for ps in plans for p in ps if "Broadcast" in p]
