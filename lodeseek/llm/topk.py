"""Exact top-k search by inner product with a pivot-distance index.

Each candidate is keyed by its nearest pivot and the distance to it. In that order the candidates are cut into cells,
and each cell into annuli of a few hundred vectors with their least and greatest distance and greatest norm. For a
query at distance d of a pivot, the triangle inequality bounds the distance to an annulus from below, and with the norms
so the inner product from above: |q|^2 + |c|^2 - |q-c|^2 = 2 qc.

A query first visits the cells of highest bound that hold k candidates; its k-th score there is its floor. Only the
pairs of a query and a cell whose bound reaches the floor are then joined, by the cell's number, and inside a cell the
annuli are expanded by falling bound until none reaches the floor, which rises meanwhile. Where distances tell little
(random directions in many dimensions) the bounds exclude little and the search becomes a full scan in blocks; results
are exact in either case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import arrow, checkpoint, partitions

K = 5
PIVOTS = 32
#: Vectors that the pivots are fitted on, at most: those with the least hash of their id. All vectors are indexed.
SAMPLE = 4096
#: Vectors in an annulus, and queries that visit it together, at most.
ANNULUS = 512
#: Indexed vectors in a cell, and queries that visit it in one task, at most.
CELL = 1 << 14
#: Cells at most: beyond, cells grow. A query compares itself with the bounds of all cells, of which the executors hold a
#: table of some tens of bytes each.
CELLS = 1 << 16
#: Largest integer that double precision adds without rounding.
_EXACT = float(1 << 53)


def quantise(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id long, vector array<double>): floor(scale * x) of each component; rows that are null or hold null or non-finite components are left out."""
    rows = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("vector"))


def fit_pivots(vectors: DataFrame, dim: int, pivots: int = PIVOTS, sample: int = SAMPLE, rounds: int = 5) -> np.ndarray:
    """Means of a few rounds of k-means over a bounded sample, the vectors with the least hash of vec_id; fewer where there are fewer distinct vectors."""
    keyed = vectors.withColumn("h", F.xxhash64("vec_id"))
    n, share = vectors.count(), 1.0
    if n > 4 * sample:
        share = 2 * sample / n  # so that a partition brings few more rows than are wanted of it
    while True:
        most = min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))
        rows = keyed.where(F.col("h") <= most).orderBy("h", "vec_id").limit(sample).collect()
        if len(rows) == sample or share == 1:
            break
        share = min(1.0, 16 * share)
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x[i, : len(r["vector"])] = r["vector"]
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(3).permutation(len(x))]
    centre = x[:pivots].copy()
    for _ in range(rounds):
        near = _distances(x, centre).argmin(axis=1)
        for p in range(len(centre)):
            if (near == p).any():
                centre[p] = x[near == p].mean(axis=0)
    return centre


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centre * centre).sum(axis=1) - 2 * x @ centre.T, 0))


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * dim and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _index(vectors: DataFrame, dim: int, pivots: np.ndarray, cells: int) -> DataFrame:
    """The vectors by nearest pivot and distance, cut into annuli: (cell int, pivot int, near, far, norm double, n int, ids binary, vectors binary)."""

    def key(batches):
        for batch in batches:
            d = _distances(_dense(batch.column(1), dim), pivots)
            p = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["vec_id", "vector", "pivot", "distance"])

    def chunk(batches):
        for batch in batches:
            x, p = _dense(batch.column(1), dim), batch.column(2).to_numpy()
            d, ids, cell = batch.column(3).to_numpy(), batch.column(0).to_numpy(), batch.column(4)[0].as_py() if batch.num_rows else 0
            edges = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))).tolist() + [len(p)] if len(p) else [0]
            cuts = [(a, min(a + ANNULUS, e)) for s, e in zip(edges[:-1], edges[1:], strict=True) for a in range(s, e, ANNULUS)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([cell] * len(cuts), pa.int32()),
                    pa.array([int(p[a]) for a, _ in cuts], pa.int32()),
                    pa.array([float(d[a:b].min()) for a, b in cuts], pa.float64()),
                    pa.array([float(d[a:b].max()) for a, b in cuts], pa.float64()),
                    pa.array([float((x[a:b] ** 2).sum(axis=1).max()) for a, b in cuts], pa.float64()),
                    pa.array([b - a for a, b in cuts], pa.int32()),
                    pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()),
                ],
                names=["cell", "pivot", "near", "far", "norm", "n", "ids", "vectors"],
            )

    keyed = arrow(vectors.select("vec_id", "vector"), key, "vec_id long, vector array<double>, pivot int, distance double")
    order = ["pivot", "distance", "vec_id"]
    # vec_id parts the vectors of one distance too, so that no cell takes a third of all rows. The number of its partition
    # names a cell for good, as the index is written before it is used.
    dealt = keyed.repartitionByRange(cells, *order).sortWithinPartitions(*order).withColumn("cell", F.spark_partition_id())
    return arrow(dealt, chunk, "cell int, pivot int, near double, far double, norm double, n int, ids binary, vectors binary")


def _bounds(q: np.ndarray, away: np.ndarray, pivot: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each query and annulus (or cell's part) an upper bound of the inner product. away: the queries' distances to all pivots."""
    d = away[:, pivot]
    gap = np.maximum(np.maximum(near - d, d - far) * (1 - 1e-9) - 1e-6, 0)
    top = ((q * q).sum(axis=1)[:, None] + norm - gap**2) / 2
    return top + 1e-6 + np.abs(top) * 1e-9


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in Python integers where doubles might round, held within 64 bits."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= _EXACT:
        exact = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in c], dtype=object).T
        return np.vectorize(lambda v: max(-(1 << 63), min((1 << 63) - 1, v)), otypes=[np.int64])(exact)
    return (q @ c.T).astype(np.int64)


class _Best:
    """The k best (score, id) so far of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.least = ids, k, floor
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.valid = np.zeros((len(ids), k), dtype=bool)

    def floor(self) -> np.ndarray:
        return np.maximum(self.least, np.where(self.valid[:, -1], self.score[:, -1].astype(np.float64), -np.inf))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        valid = ids[None, :] != self.ids[rows][:, None]
        take = min(self.k + 1, score.shape[1])
        if score.shape[1] > 4 * take:
            # The k-th score of each row, with all its ties, before the exact order.
            masked = np.where(valid, score, np.iinfo(np.int64).min)
            least = np.partition(masked, -take, axis=1)[:, -take]
            keep = np.flatnonzero((masked >= least[:, None]).any(axis=0))
            score, valid, ids = score[:, keep], valid[:, keep], ids[keep]
        s = np.concatenate((self.score[rows], score), axis=1)
        i = np.concatenate((self.found[rows], np.broadcast_to(ids, score.shape)), axis=1)
        v = np.concatenate((self.valid[rows], valid), axis=1)
        order = np.lexsort((i, np.where(v, -s.astype(np.float64), np.inf), ~v), axis=1)[:, : self.k] if np.abs(s[v]).max(initial=0) < _EXACT else self._slow(s, i, v)
        pick = np.arange(len(rows))[:, None]
        self.score[rows], self.found[rows], self.valid[rows] = s[pick, order], i[pick, order], v[pick, order]

    def _slow(self, s, i, v):
        return np.array([sorted(range(s.shape[1]), key=lambda c: (not v[r, c], -int(s[r, c]), int(i[r, c])))[: self.k] for r in range(len(s))])


def _directory(index: DataFrame) -> tuple[np.ndarray, ...]:
    """Arrays (cell, pivot, near, far, norm, n) with one entry for each pivot of a cell: a bounded table, by CELLS."""
    rows = index.groupBy("cell", "pivot").agg(F.min("near"), F.max("far"), F.max("norm"), F.sum("n")).orderBy("cell", "pivot").collect()
    kinds = (np.int64, np.int64, np.float64, np.float64, np.float64, np.int64)
    return tuple(np.array([r[i] for r in rows], dtype=kind) for i, kind in enumerate(kinds))


def _visits(queries: DataFrame, directory: tuple, centre: np.ndarray, dim: int, k: int, first: bool) -> DataFrame:
    """(vec_id, vector, floor) -> (cell, vec_id, vector, floor): the cells that a query visits first, or the other ones whose bound reaches its floor."""
    cell, pivot, near, far, norm, n = directory
    heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    names, sizes = cell[heads], np.add.reduceat(n, heads)

    def run(batches):
        step = max(1, min(ANNULUS, (1 << 21) // len(cell)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                q = _dense(batch.column(1), dim)
                top = np.maximum.reduceat(_bounds(q, _distances(q, centre), pivot, near, far, norm), heads, axis=1)
                # The first cells are those of highest bound until they hold k candidates beside the query itself.
                order = np.argsort(-top, axis=1, kind="stable")
                seen = np.cumsum(sizes[order], axis=1) - sizes[order]
                initial = np.zeros(top.shape, dtype=bool)
                np.put_along_axis(initial, order, seen < k + 1, axis=1)
                row, at_cell = np.nonzero(initial if first else ~initial & (top >= batch.column(2).to_numpy()[:, None]))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(names[at_cell].astype(np.int32)), *[c.take(rows) for c in batch.columns]], names=["cell", "vec_id", "vector", "floor"])

    return arrow(queries.select("vec_id", "vector", "floor"), run, "cell int, vec_id long, vector array<double>, floor double")


_FOUND = "query_id long, vec_id long, score long, scored long"


def _scored(visits: DataFrame, index: DataFrame, centre: np.ndarray, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, scored): the k best of each visited cell that reach the query's floor, and in a row without vec_id how many candidates it was scored with."""
    # A cell that many queries visit is shared out: each part takes some of the queries and all of the cell.
    parts = checkpoint(visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("parts")))  # written, so that the planner can split a hot cell of the joins
    asked = visits.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    held = index.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(asked: pd.DataFrame, annuli: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(annuli):
            asked = asked.sort_values("vec_id")
            ids, floor = asked["vec_id"].to_numpy(), asked["floor"].to_numpy()
            q = np.zeros((len(ids), dim))
            for i, v in enumerate(asked["vector"]):
                q[i, : len(v)] = v
            away = _distances(q, centre)
            order = np.lexsort((away.min(axis=1), away.argmin(axis=1)))
            for at in range(0, len(order), ANNULUS):
                some = order[at : at + ANNULUS]
                out.append(_search(q[some], ids[some], away[some], floor[some], annuli, dim, k))
        found = [[np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)], [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in (3, 4)]]
        best = pd.DataFrame({"query_id": found[0][0], "vec_id": pd.array(found[0][1], "Int64"), "score": pd.array(found[0][2], "Int64"), "scored": 0})
        work = pd.DataFrame({"query_id": found[1][0], "vec_id": pd.array([pd.NA] * len(found[1][0]), "Int64"), "score": pd.array([pd.NA] * len(found[1][0]), "Int64"), "scored": found[1][1]})
        return pd.concat((best, work), ignore_index=True)

    ship(index.sparkSession)
    keys = ["cell", "part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, _FOUND)


def searched(embeddings: DataFrame, k: int = K, every: int = 50, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE, cell: int = CELL) -> DataFrame | None:
    """All that top_k finds on its way, as (query_id, vec_id, score, scored), see _scored; None if there is no vector."""
    spark = embeddings.sparkSession
    vectors = quantise(embeddings, scale)
    dim, rows = vectors.agg(F.max(F.size("vector")), F.count("*")).first()
    if dim is None:
        return None
    dim = max(1, dim)
    centre = fit_pivots(vectors, dim, pivots, sample)
    # Small tables are cut finer, so that all tasks have work, and very large ones into CELLS cells.
    cells = max(1, min(CELLS, max(-(-rows // cell), min(2 * partitions(spark), rows // ANNULUS))))
    index = checkpoint(_index(vectors, dim, centre, cells))
    directory = _directory(index)
    queries = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("floor", F.lit(float("-inf")))
    queries = checkpoint(queries)
    first = checkpoint(_scored(_visits(queries, directory, centre, dim, k, True), index, centre, dim, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    known = queries.drop("floor").join(kth, "vec_id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf"))))
    rest = _scored(checkpoint(_visits(known, directory, centre, dim, k, False)), index, centre, dim, k)
    return first.unionByName(rest)


def top_k(embeddings: DataFrame, k: int = K, every: int = 50, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id long, rank int, vec_id long, score long) for the rows whose vec_id is divisible by ``every``.

    Components are floor(scale * x); the score is their inner product; ties go to the smaller vec_id. A query's own
    vec_id is no candidate. Vectors that are null or hold null or non-finite components, and rows with a null vec_id,
    take no part; shorter vectors count as padded with zeros. Repeated rows (equal vec_id) are each a candidate,
    and a query once. With fewer than k candidates all are returned; scores beyond 64 bits are held at the limit.
    """
    found = searched(embeddings, k, every, scale, pivots, sample, cell)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _search(q: np.ndarray, ids: np.ndarray, away: np.ndarray, floor: np.ndarray, annuli: pd.DataFrame, dim: int, k: int) -> tuple:
    """The k best of a block of queries among annuli, expanded by falling bound, and for each query the number of candidates scored."""
    top = _bounds(q, away, *[annuli[c].to_numpy() for c in ("pivot", "near", "far", "norm")])
    best, highest, scored = _Best(ids, k, floor), top.max(axis=0), np.zeros(len(ids), np.int64)
    for a in np.argsort(-highest, kind="stable").tolist():
        least = best.floor()
        if highest[a] < least.min():
            break
        rows = np.flatnonzero(top[:, a] >= least)
        if len(rows):
            c = np.frombuffer(annuli["vectors"].iloc[a]).reshape(-1, dim)
            scored[rows] += len(c)
            best.add(rows, _scores(q[rows], c), np.frombuffer(annuli["ids"].iloc[a], dtype=np.int64))
    at = np.nonzero(best.valid & (best.score.astype(np.float64) >= floor[:, None]))
    return best.ids[at[0]], best.found[at], best.score[at], ids, scored
