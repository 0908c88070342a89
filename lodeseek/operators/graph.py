"""Graph search over single vectors: each shard of an index is a navigable graph, and a search walks it with a beam.

Spark deals vectors out to shards of bounded size, pieces of clusters, and a task links the vectors of a shard: candidates
are the nearest by one product, of which a vector keeps those that are nearer to it than to each other, so that links lead
in all directions; links go both ways, and some lead to hashed, far ones. A shard is one row with its vectors and links packed, so what
is stored is a Parquet table by cluster. A search joins shards with blocks of the queries that probe their cluster, and all queries of a block walk at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B
from . import quantize as Z
from . import search as Q
from .scoring import top_k

#: Vectors of a shard, about: linking them takes a product of that many by that many.
SHARD = 8192
#: Links that a vector chooses (as many again may come from others), candidates it chooses from, and far links.
LINKS, CANDIDATES, FAR = 16, 100, 2
#: Vectors of a shard that a walk may start from.
STARTS = 64
FIELDS = "key long, ids binary, data binary, links binary, n int"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.EPS)


def _spread(x: np.ndarray, at: int, near: np.ndarray, links: int) -> np.ndarray:
    """For the vectors from ``at`` on, those of their candidates (rows of near, the best first) that are nearer to them than to any candidate kept before; -1 where fewer are kept."""
    own, rows = x[at : at + len(near)], np.arange(len(near))
    kept = np.full((len(near), links), -1, dtype=np.int32)
    count = np.zeros(len(near), dtype=np.int64)
    for c in near.T:
        away = np.einsum("nd,nkd->nk", x[c], x[kept])
        away[kept < 0] = -np.inf
        take = (np.einsum("nd,nd->n", own, x[c]) > away.max(axis=1)) & (count < links) & (c != at + rows)
        kept[rows[take], count[take]] = c[take]
        count += take
    return kept


def linked(x: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES, far: int = FAR) -> np.ndarray:
    """(n, 2 * links + far) places of the vectors that each unit vector is linked with, -1 for none."""
    n, wide = len(x), min(candidates, len(x) - 1)
    chosen = np.full((n, links), -1, dtype=np.int32)
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        some = np.argpartition(-s, max(0, wide - 1), axis=1)[:, :wide]
        near = np.take_along_axis(some, np.argsort(-np.take_along_axis(s, some, axis=1), axis=1, kind="stable"), axis=1)
        chosen[at : at + len(s)] = _spread(x, at, near, links)
    # The other way: of those that have chosen a vector, it links back to the nearest ones.
    to, rank = chosen.ravel(), np.tile(np.arange(links), n)
    source = np.repeat(np.arange(n, dtype=np.int32), links)[to >= 0]
    rank, to = rank[to >= 0], to[to >= 0]
    order = np.lexsort((source, rank, to))
    to, source = to[order], source[order]
    nth = np.arange(len(to)) - np.searchsorted(to, to)
    back = np.full((n, links), -1, dtype=np.int32)
    some = nth < links
    back[to[some], nth[some]] = source[some]
    jumps = np.random.default_rng(n).integers(0, max(1, n), (n, far), dtype=np.int32)
    every = np.sort(np.concatenate((chosen, back, jumps), axis=1), axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1  # each link once
    return every


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, ef: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, products) of the k best vectors that each query finds, -1 for none: a beam of the ``ef`` best so far, of which the best one not yet expanded is expanded next."""
    n, ef = len(x), max(ef, k)
    first = np.unique(np.linspace(0, n - 1, min(n, STARTS)).astype(np.int64))
    place, score = np.tile(first, (len(q), 1)), q @ x[first].T
    seen = np.zeros((len(q), n), dtype=bool)
    seen[:, first] = True
    open_ = np.ones(place.shape, dtype=bool)
    rows = np.arange(len(q))
    while True:
        if place.shape[1] > ef:
            best = np.argpartition(-score, ef - 1, axis=1)[:, :ef]
            place, score, open_ = (np.take_along_axis(a, best, axis=1) for a in (place, score, open_))
        wanted = np.where(open_ & (place >= 0), score, -np.inf)
        at = wanted.argmax(axis=1)
        live = np.flatnonzero(wanted[rows, at] > -np.inf)
        if not len(live):
            break
        open_[live, at[live]] = False
        more = links[place[live, at[live]]].astype(np.int64)
        new = (more >= 0) & ~seen[live[:, None], more]
        r, c = np.nonzero(new)
        seen[live[r], more[r, c]] = True
        s = np.where(new, np.einsum("qd,qld->ql", q[live], x[more]), -np.inf)
        add = np.full((len(q), more.shape[1]), -1, dtype=np.int64), np.full((len(q), more.shape[1]), -np.inf)
        add[0][live], add[1][live] = np.where(new, more, -1), s
        place, score = np.concatenate((place, add[0]), axis=1), np.concatenate((score, add[1]), axis=1)
        open_ = np.concatenate((open_, add[0] >= 0), axis=1)
    order = np.lexsort((place, -score), axis=1)[:, :k]
    return np.take_along_axis(place, order, axis=1), np.take_along_axis(score, order, axis=1)


def build_graph(vectors: DataFrame, centroids: DataFrame, shard: int = SHARD, links: int = LINKS, candidates: int = CANDIDATES) -> DataFrame:
    """(doc_id, vec) -> FIELDS: a row for each shard, key being its cluster. Vectors are made unit vectors; incomplete ones are left out, null ids too.

    A cluster of more than ``shard`` vectors is cut by a hash of the id into several shards, so that one that holds a third of all vectors
    is many tasks, and no shard grows with the data.
    """
    dim = B.width(vectors, "vec")
    near = Z.assign_nearest(vectors.where("doc_id is not null").select("doc_id", V.doubles("vec").alias("vec")), centroids)
    if dim is None:
        return vectors.sparkSession.createDataFrame([], FIELDS)
    sizes = near.groupBy("cluster_id").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("_pieces")).withColumnRenamed("cluster_id", "_c")
    cut = near.join(F.broadcast(sizes), F.col("cluster_id") == F.col("_c")) if centroids.count() * 12 <= B.BROADCAST else near.join(sizes, F.col("cluster_id") == F.col("_c"))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("_pieces"))
    rows = cut.select((F.col("cluster_id").cast("long") * (1 << 31) + piece).alias("key"), F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("sub"), "vec")
    packed = B.pack(rows.repartition("key").sortWithinPartitions("key", "id"), dim, 2 * shard, single=True)

    def run(batches):
        for batch in batches:
            for key, ids, _, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                n = len(ids) // 8
                x = _unit(B.vectors_of(data, n, dim)).astype(np.float32)
                graph = linked(x, links, candidates)
                yield pa.RecordBatch.from_arrays([pa.array([key >> 31]), pa.array([ids], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([graph.tobytes()], pa.binary()), pa.array([n], pa.int32())], names=["key", "ids", "data", "links", "n"])

    return B.arrow(packed, run, FIELDS)


def search_graph(graph: DataFrame, centroids: DataFrame, queries: DataFrame, ef: int | list[int] = 128, nprobe: int = 8, k: int = 10) -> DataFrame:
    """(ef, query_id, doc_id, score, rank): the k best vectors by cosine that walks with a beam of ``ef`` find in the nprobe best clusters, a list of ef in one job. A vector is no neighbour of its own id.

    queries (query_id, qvec). A walk scores some ef * links vectors of a shard, whatever its size; a larger ef finds more.
    """
    spread, shape = [ef] if isinstance(ef, int) else list(ef), B.shape(centroids, "cvec")
    names = "ef int, query_id long, doc_id long, score double"
    if shape[1] is None:
        return queries.sparkSession.createDataFrame([], names + ", rank int")
    dim = shape[1]
    asked = queries.select("query_id", F.lit(0).alias("q_tok"), V.doubles("qvec").alias("qvec"))
    blocks = Q._probing_blocks(Q.probes(asked, centroids, min(nprobe, shape[0]), shape), asked, centroids, dim, False)
    pairs = B.of_key(graph, blocks.select("key", "ids", "data"))

    def run(batches):
        for batch in batches:
            for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "data", "links", "n", "qids", "qdata")], strict=True):
                ids, data, links, n, qids, qdata = row
                ids, qids, x = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64), np.frombuffer(data, np.float32).reshape(n, dim)
                graph = np.frombuffer(links, np.int32).reshape(n, -1)
                q = _unit(np.frombuffer(qdata).reshape(-1, dim)).astype(np.float32)
                for beam in spread:
                    place, score = walk(x, graph, q, beam, k + 1)
                    some = place >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), beam, np.int32)), pa.array(np.broadcast_to(qids[:, None], place.shape)[some]), pa.array(ids[place[some]]), pa.array(score[some].astype(np.float64))], names=["ef", "query_id", "doc_id", "score"])

    found = B.arrow(pairs, run, names).where("doc_id <> query_id")
    return top_k(found, k, by=("ef", "query_id"))


def write_graph(graph: DataFrame, centroids: DataFrame, path: str) -> None:
    """Shards sorted by cluster, whose file statistics let a search skip those it does not probe, and the centroids."""
    graph.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/shards")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(shards, centroids)."""
    return spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/centroids")
