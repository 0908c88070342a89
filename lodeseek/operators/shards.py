"""Pruned search inside shards: whole documents stay together, and each task scores, of its own shards, only the probed clusters.

A document's tokens lie in many clusters. Dealt out by document, they meet in one task, which sums a document's score itself and
gives back no more than the k best of each query: neither candidates nor tokens are shuffled by a search. A stored index is such
shards already. Queries and centroids go to all tasks, behind a check of their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B
from . import quantize as Z

#: Vectors or codes of a shard, about.
SHARD = 16_384


def shards(tokens: DataFrame, value: str, dim: int | None) -> DataFrame:
    """tokens (doc_id, cluster_id, value) -> (key, ids, subs, data): blocks of whole documents, subs being clusters. dim None: value holds codes."""
    column = F.col(value) if dim is None else V.doubles(value)
    rows = tokens.select(F.lit(0).cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("cluster_id").cast("long").alias("sub"), column.alias("value"))
    return B.pack(rows.repartition("doc_id").sortWithinPartitions("doc_id"), dim, SHARD)


@dataclass
class Asked:
    """Queries in order of id: their ids, where each one's tokens begin, the tokens' vectors, and for each the clusters it probes with their ranks."""

    ids: np.ndarray
    first: np.ndarray
    vectors: np.ndarray
    probed: list[tuple[np.ndarray, np.ndarray]]


def asked(queries: DataFrame, dim: int, centroids: np.ndarray, names: np.ndarray, most: int | None) -> Asked:
    """queries (query_id, q_tok, qvec); those without an id or a complete vector are left out. most None: every cluster, at rank 1."""
    rows = queries.where("query_id is not null and q_tok is not null").select(F.col("query_id").cast("long"), F.col("q_tok").cast("long"), V.doubles("qvec")).collect()
    rows = sorted((q, t, v) for q, t, v in rows if v is not None and len(v) == dim and None not in v)
    ids, x = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.float64).reshape(-1, dim)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    probed = []
    for a, b in zip(first, [*first[1:], len(ids)], strict=True):
        if most is None:
            probed.append((names, np.ones(len(names), dtype=np.int32)))
            continue
        best: dict[int, int] = {}
        for at in range(a, b, 64):
            s = np.round(x[at : min(b, at + 64)] @ centroids.T, V.TIE_DIGITS)
            for order in np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :most]:
                for rank, c in enumerate(names[order].tolist(), 1):
                    best[c] = min(rank, best.get(c, rank))
        clusters = sorted(best)
        probed.append((np.array(clusters, dtype=np.int64), np.array([best[c] for c in clusters], dtype=np.int32)))
    return Asked(ids[first], np.append(first, len(ids)), x, probed)


def local_scores(held: DataFrame, kernel: B.Products, queries: Asked, nprobes: list[int | None], k: int, terms: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(nprobe int, query_id, doc_id, score): of the shards, the rows that may be among a query's k best, for each of the settings.

    terms: (names, matrix) of the centroids, whose product with a query token is added to the scores of the cluster's codes.
    """
    sent = held.sparkSession.sparkContext.broadcast((queries, terms))

    def run(batches):
        asked, terms = sent.value
        tops = [B._Top(k) for _ in nprobes]
        for batch in batches:
            for row in zip(*[batch.column(i) for i in (1, 2, 3)], strict=True):  # one shard at a time
                ids, subs, data = (x.as_py() for x in row)
                ids, subs = np.frombuffer(ids, np.int64), np.frombuffer(subs, np.int64)
                rows = kernel.rows(data, len(ids))
                order = np.argsort(subs, kind="stable")  # by cluster, and by document in each
                ids, subs, rows = ids[order], subs[order], rows[order]
                heads = np.flatnonzero(np.append(True, subs[1:] != subs[:-1]))
                names, ends = subs[heads], np.append(heads[1:], len(subs))
                for j, (clusters, ranks) in enumerate(asked.probed):
                    at = np.minimum(np.searchsorted(names, clusters), len(names) - 1)
                    there = np.flatnonzero(names[at] == clusters)
                    if not len(there):
                        continue
                    q, spans = asked.vectors[asked.first[j] : asked.first[j + 1]], [slice(heads[i], ends[i]) for i in at[there]]
                    s = np.concatenate([kernel.of(rows[p], q) for p in spans])
                    docs, each = np.concatenate([ids[p] for p in spans]), [p.stop - p.start for p in spans]
                    if terms is not None:
                        s += np.repeat(terms[1][np.searchsorted(terms[0], clusters[there])] @ q.T, each, axis=0)
                    by, rank = np.argsort(docs, kind="stable"), np.repeat(ranks[there], each)
                    s, docs, rank = s[by], docs[by], rank[by]
                    for top, n in zip(tops, nprobes, strict=True):
                        some = slice(None) if n is None or rank.max() <= n else np.flatnonzero(rank <= n)
                        d, best = docs[some], s[some]
                        if len(d):
                            new = B._heads(d)
                            top.add(asked.ids[j : j + 1], d[new], np.add.reduce(np.maximum.reduceat(best, new, axis=0), axis=1)[:, None])
        for top, n in zip(tops, nprobes, strict=True):
            for part in top.rows():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, n or 0, np.int32)), *part.columns], names=["nprobe", "query_id", "doc_id", "score"])

    return B.arrow(held, run, "nprobe int, query_id long, doc_id long, score double")


def search(held: DataFrame, kernel: B.Products, queries: DataFrame, centroids: DataFrame, nprobes: list[int | None], k: int, terms: bool) -> DataFrame | None:
    """local_scores of queries (query_id, q_tok, qvec); None where queries or centroids are more than a table may be that goes to all executors."""
    n, dim = B.shape(queries, "qvec")
    if dim is None:
        return held.sparkSession.createDataFrame([], "nprobe int, query_id long, doc_id long, score double")
    model = Z.centroid_matrix(centroids) if 8 * n * dim <= B.BROADCAST else None
    if model is None:
        return None
    most = None if None in nprobes else max(nprobes)
    return local_scores(held, kernel, asked(queries, kernel.dim, model[1], model[0].astype(np.int64), most), nprobes, k, (model[0].astype(np.int64), model[1]) if terms else None)
