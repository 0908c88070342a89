"""k-means and codebooks trained on every row, in passes of partial sums.

A pass holds each batch of vectors against the model, which all tasks get, and gives back sums: a task gives one row for each
centroid that it meets, and these are added up by centroid. Seeds are drawn over all rows too: in a few rounds each vector is taken in
proportion to its squared distance from what has been taken, and what is taken is weighted by the vectors nearest to it (Bahmani et
al., 2012). A codebook's parts are trained side by side in the same passes. Only models, candidates for them and their sums reach the driver,
and their size is bounded by that of a table that goes to all executors. Draws follow hashes of the ids, so that a repeated fit is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B

#: Rounds of drawing at least, passes that move centroids at most, and the gain below which they end.
ROUNDS, PASSES, GAIN = 3, 25, 1e-4
#: Centroids up to which the drawn candidates are thinned out by distance; beyond, the heaviest are taken.
THINNED = 4096


def _rows(tokens: DataFrame) -> DataFrame:
    """(h long, vec) of the vectors without nulls and with finite components; h follows the id."""
    whole = "vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    return tokens.select(F.xxhash64("token_id").alias("h"), V.doubles("vec").alias("vec")).where(whole)


def _parted(batches: Iterator[pa.RecordBatch], m: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, vectors (m, n, size)) of batches (h, vec)."""
    for batch in B._slices(batches):
        x, at = B.dense(batch.column(1), m * size)
        if len(x):
            yield batch.column(0).to_numpy()[at].view(np.uint64), np.ascontiguousarray(x.reshape(len(x), m, size).swapaxes(0, 1))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow a hash and a salt."""
    x = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


class _Passes:
    """Passes over (h, vec) with a model of m parts, each a matrix of its own number of centroids."""

    def __init__(self, rows: DataFrame, m: int, size: int):
        self.rows, self.m, self.size = rows, m, size

    def _run(self, model: list[np.ndarray], function: Callable, schema: str) -> DataFrame:
        sent, m, size = self.rows.sparkSession.sparkContext.broadcast(model), self.m, self.size
        return B.arrow(self.rows, lambda batches: function(sent.value, _parted(batches, m, size)), schema)

    def cost(self, model: list[np.ndarray]) -> np.ndarray:
        """The sum of squared distances of each part."""

        def run(model, batches):
            total = np.zeros(len(model))
            for _, x in batches:
                total += [B.nearest(v, c)[1].sum() for v, c in zip(x, model, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(model), dtype=np.int32)), pa.array(total)], names=["part", "d"])

        found = dict(map(tuple, self._run(model, run, "part int, d double").groupBy("part").agg(F.sum("d")).collect()))
        return np.array([found.get(k, 0.0) for k in range(self.m)])

    def drawn(self, model: list[np.ndarray], cost: np.ndarray, wanted: int, salt: int) -> list[np.ndarray]:
        """New candidates of each part, about ``wanted``: each vector with probability wanted * d / cost."""

        def run(model, batches):
            for h, x in batches:
                for part, (v, c) in enumerate(zip(x, model, strict=True)):
                    if cost[part] > 0:
                        take = np.flatnonzero(_uniform(h, salt * len(model) + part) * cost[part] < wanted * B.nearest(v, c)[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), part, np.int32)), pa.array(h[take].view(np.int64)), pa.array([r.tobytes() for r in v[take]], pa.binary())], names=["part", "h", "v"])

        out: list[list[np.ndarray]] = [[] for _ in range(self.m)]
        for part, _, v in sorted(map(tuple, self._run(model, run, "part int, h long, v binary").collect())):
            out[part].append(np.frombuffer(bytes(v)))
        return [np.unique(np.array(v).reshape(-1, self.size), axis=0) for v in out]

    def sums(self, model: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """Of each part (vectors by centroid, their sums, all squared distances, all distances)."""
        size, first = self.size, np.cumsum([0, *[len(c) for c in model]])

        def run(model, batches):
            counts, totals = [np.zeros(len(c), np.int64) for c in model], [np.zeros(c.shape) for c in model]
            d2, d1 = ([np.zeros(len(c)) for c in model] for _ in range(2))
            for _, x in batches:
                for part, (v, c) in enumerate(zip(x, model, strict=True)):
                    at, d = B.nearest(v, c)
                    counts[part] += np.bincount(at, minlength=len(c))
                    d2[part] += np.bincount(at, d, len(c))
                    d1[part] += np.bincount(at, np.sqrt(d), len(c))
                    for j in range(size):
                        totals[part][:, j] += np.bincount(at, v[:, j], len(c))
            n, a, b, t = (np.concatenate(z) for z in (counts, d2, d1, totals))
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[hit]), pa.array(a[hit]), pa.array(b[hit]), pa.array([r.tobytes() for r in t[hit]], pa.binary())], names=["slot", "n", "d2", "d1", "v"])

        def added(batches):
            have: dict[int, list] = {}
            for batch in batches:
                for slot, *more, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    old = have.setdefault(slot, [0, 0.0, 0.0, np.zeros(size)])
                    have[slot] = [*[p + q for p, q in zip(old, more, strict=False)], old[3] + np.frombuffer(v)]
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), *[pa.array([x[k] for x in have.values()], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], pa.array([x[3].tobytes() for x in have.values()], pa.binary())], names=["slot", "n", "d2", "d1", "v"])

        schema = "slot int, n long, d2 double, d1 double, v binary"
        found = B.arrow(self._run(model, run, schema).repartition("slot"), added, schema).collect()
        n, d2, d1, v = np.zeros(first[-1], np.int64), np.zeros(first[-1]), np.zeros(first[-1]), np.zeros((first[-1], size))
        for slot, *numbers, total in found:
            n[slot], d2[slot], d1[slot] = numbers
            v[slot] = np.frombuffer(bytes(total))
        return [(n[a:b], v[a:b], float(d2[a:b].sum()), float(d1[a:b].sum())) for a, b in zip(first[:-1], first[1:], strict=True)]


def _thinned(c: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the candidates: drawn by weight times squared distance from those before, the best of several draws; the heaviest if there are very many."""
    if len(c) <= k:
        return c
    if k > THINNED:
        return c[np.sort(np.argsort(-weight, kind="stable")[:k])]
    best = None
    for start in range(5):
        rng = np.random.default_rng((seed, start))
        out = [int(rng.choice(len(c), p=weight / weight.sum()))]
        d = ((c - c[out[0]]) ** 2).sum(axis=1)
        while len(out) < k:
            p = weight * d
            out.append(int(rng.choice(len(c), p=p / p.sum())) if p.sum() > 0 else int(np.setdiff1d(np.arange(len(c)), out)[0]))
            d = np.minimum(d, ((c - c[out[-1]]) ** 2).sum(axis=1))
        x = c[out]
        for _ in range(10):
            at, d = B.nearest(c, x)
            n = np.bincount(at, weight, k)
            sums = np.stack([np.bincount(at, weight * c[:, j], k) for j in range(c.shape[1])], axis=1)
            x = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], x)
        cost = float((B.nearest(c, x)[1] * weight).sum())
        if best is None or cost < best[0]:
            best = (cost, x)
    return best[1]


def fit(tokens: DataFrame, m: int, k: int, dim: int, seed: int = 42, passes: int = PASSES) -> list[tuple[np.ndarray, float]]:
    """Of each of m parts of the vectors (token_id, vec): (centroids, mean distance from the nearest), trained on all rows.

    Fewer than k centroids where a part has fewer distinct values; none without vectors. A centroid that loses all its vectors stays.
    """
    size = V.check_parts(dim, m)
    if 8 * k * dim > B.BROADCAST:
        raise ValueError("a model that goes to all executors has 64 MB at most")
    rows = _rows(tokens).where(F.size("vec") == dim)
    first = rows.agg(F.min_by("vec", F.struct(F.xxhash64("h", F.lit(seed)), "vec"))).first()[0]
    if first is None:
        return [(np.zeros((0, size)), 0.0)] * m
    work = _Passes(rows, m, size)
    model = list(np.array(first, dtype=np.float64).reshape(m, 1, size))
    for turn in range(10 * ROUNDS):
        cost = work.cost(model)
        open_ = [len(c) < k and d > 0 for c, d in zip(model, cost, strict=True)]
        if turn >= ROUNDS and not any(open_):
            break
        if turn >= ROUNDS:
            cost = np.where(open_, cost, 0.0)
        model = [np.concatenate((c, new)) for c, new in zip(model, work.drawn(model, cost, k, seed * 1000 + turn), strict=True)]
    weights = [n for n, *_ in work.sums(model)]
    model = [_thinned(c, w.astype(np.float64), k, seed + part) for part, (c, w) in enumerate(zip(model, weights, strict=True))]
    before = None
    for turn in range(passes + 1):
        sums = work.sums(model)
        now = sum(d2 for *_, d2, _ in sums)
        if turn == passes or before is not None and now >= before * (1 - GAIN):
            break
        before = now
        model = [np.where(n[:, None] > 0, v / np.maximum(n, 1)[:, None], c) for c, (n, v, *_) in zip(model, sums, strict=True)]
    return [(c, d1 / max(1, int(n.sum()))) for c, (n, _, _, d1) in zip(model, sums, strict=True)]
