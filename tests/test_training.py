"""Training on all rows: its passes against plain numpy and the SQL-checked step, its result against k-means of the usual kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import quantize, train


def nearest(x, c):
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def plain(x, k, starts=3):
    """The least mean squared distance of a few runs of Lloyd's steps from k-means++ seeds."""
    best = np.inf
    for s in range(starts):
        rng = np.random.default_rng(s)
        c = [x[rng.integers(len(x))]]
        while len(c) < k:
            d = nearest(x, np.array(c))[1]
            c.append(x[rng.choice(len(x), p=d / d.sum())])
        c = np.array(c)
        for _ in range(30):
            at, d = nearest(x, c)
            c = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
        best = min(best, nearest(x, c)[1].mean())
    return best


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 6)) * 0.4 + (rng.standard_normal((12, 6)) * 2)[rng.integers(0, 12, 900)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [1.0]), (1004, [float("inf")] * 6)]
    return x, spark.createDataFrame(rows + odd, "token_id long, vec array<double>").repartition(5)


def test_error_is_no_worse_than_usual(spark, table):
    x, tokens = table
    (c, error), = train.fit(tokens, 1, 12, 6)
    assert c.shape == (12, 6) and nearest(x, c)[1].mean() <= 1.05 * plain(x, 12)
    assert error == pytest.approx(np.sqrt(nearest(x, c)[1]).mean(), rel=1e-6)
    books = train.fit(tokens, 3, 8, 6)
    for part, (c, error) in enumerate(books):
        own = x[:, 2 * part : 2 * part + 2]
        assert c.shape == (8, 2) and nearest(own, c)[1].mean() <= 1.1 * plain(own, 8)
        assert error == pytest.approx(np.sqrt(nearest(own, c)[1]).mean(), rel=1e-6)
    again = train.fit(tokens.repartition(2), 3, 8, 6)
    assert all(np.allclose(a, b) for (a, _), (b, _) in zip(books, again, strict=True))


def test_a_pass_reads_every_row(spark, table):
    x, tokens = table
    start = x[:7]
    work = train._Passes(train._rows(tokens).where(F.size("vec") == 6), 1, 6)
    (n, v, d2, d1), = work.sums([start])
    at, d = nearest(x, start)
    assert n.tolist() == np.bincount(at, minlength=7).tolist() and n.sum() == 900
    assert np.allclose(v, [x[at == j].sum(axis=0) for j in range(7)]) and d2 == pytest.approx(d.sum()) and d1 == pytest.approx(np.sqrt(d).sum())
    assert work.cost([start])[0] == pytest.approx(d.sum())
    step = quantize.lloyd_step(tokens.where("token_id < 900"), spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(start)], "cluster_id int, cvec array<double>"))
    want = {r["cluster_id"]: r["cvec"] for r in step.collect()}
    assert all(np.allclose(v[j] / n[j], want[j]) for j in range(7) if n[j])
    drawn = work.drawn([start], np.array([d.sum()]), 50, 3)[0]
    assert 20 <= len(drawn) <= 90 and all((x == r).all(axis=1).any() for r in drawn)


def test_few_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)], "token_id long, vec array<double>")
    assert sorted(r["cvec"][0] for r in quantize.kmeans_train(same, 8).collect()) == [0, 1, 2]
    book = quantize.pq_train(same, 2, 4, 2).collect()
    assert sorted((r["m"], r["k"], r["cvec"][0]) for r in book if r["m"] == 1) == [(1, k, 1.0) for k in range(3)] and len(book) == 6
    none = same.where("token_id < 0")
    assert quantize.kmeans_train(none, 8).count() == 0 and train.fit(none, 2, 4, 2)[0][0].shape == (0, 1)
    with pytest.raises(ValueError):
        train.fit(same, 1, 1 << 23, 2)
