"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

A vector's key in a table is the signs of its products with ``bits`` random directions. The tables are as many as
are needed for two vectors at the threshold to share a key in one of them with probability ``recall``; ``bits``
follows from the number of vectors, so that an average group just fills a tile of a few MB. Few bits make few tables
do, and so a vector is sent to few tasks: once for each table, and not to each of many small groups. Vectors that share
a key are compared exactly in double precision, a strip of them against the tile. Larger groups are dealt out as pairs
of tiles, so no task gets a whole group and no pair leaves its task: what leaves are counts and a spanning set of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, checkpoint, partitions
from .components import components

THRESHOLD = 0.95
RECALL = 0.99
#: Vectors of one key beyond which they are compared tile by tile, and about as many in a tile.
TILE = 1 << 14
#: Vectors of an average group, and the fewest bits. The bits grow with the number of vectors without end.
FILL, MIN_BITS = 1 << 12, 4
_STRIP = 512
#: Bytes of a table of large groups that is broadcast, at most.
SMALL = 64 << 20


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(MIN_BITS, math.ceil(math.log2(max(2, vectors) / FILL)))
    share = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - share))))


def directions(dim: int, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * bits))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column without nulls in double precision; shorter ones are padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def keys_of(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """A row of keys for each vector: one for each table."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    weights = (1 << np.arange(bits)).astype(np.int64)
    return (x @ planes > 0).reshape(len(x), -1, bits) @ weights


def _links(x: np.ndarray, signs: np.ndarray, tile: np.ndarray, ta: int, tb: int, table: int, threshold: float):
    """Strips of pairs (i, j) of places that link, i in tile ta and j in tile tb, and whether no earlier table has them too."""
    left, right = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
    for at in range(0, len(left), _STRIP):
        some = left[at : at + _STRIP]
        near = x[some] @ x[right].T >= threshold
        if ta == tb:
            near &= some[:, None] < right[None, :]
        i, j = np.nonzero(near)
        i, j = some[i], right[j]
        new = np.ones(len(i), dtype=bool)
        for part in range(0, len(i) if table else 0, 1 << 16):
            s = slice(part, part + (1 << 16))
            new[s] = ~(signs[i[s], :table] == signs[j[s], :table]).any(axis=1)
        yield i, j, new


def _roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers the labels of linked places until linked ones are equal."""
    while len(i):
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)


def _compare(key: tuple[int, int, int], ids, mult, tile, x, signs, threshold: float):
    """Links of one (table, tile a, tile b) of one key: ids that have any, an id that each reaches, and how many rows they link with that no earlier table has found."""
    table, ta, tb = key
    counts, label, linked = np.zeros(len(ids), np.int64), ids.copy(), np.zeros(len(ids), dtype=bool)
    for i, j, new in _links(x, signs, tile, ta, tb, table, threshold):
        if len(i):
            counts += np.bincount(i[new], mult[j[new]], minlength=len(ids)).astype(np.int64) + np.bincount(j[new], mult[i[new]], minlength=len(ids)).astype(np.int64)
            linked[i] = linked[j] = True
            # Where a strip lowers a label that others have too, an edge joins the two labels.
            some = np.flatnonzero(linked)
            before = label[some]
            _roots(label, i, j)
            edges = np.unique(np.stack((before, label[some])), axis=1)
            edges = edges[:, edges[0] != edges[1]]
            yield edges[0], edges[1], np.zeros(edges.shape[1], np.int64)
    some = np.flatnonzero(linked)
    yield ids[some], label[some], counts[some]


def links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(id long, mult long, embedding array) of distinct vectors -> (id, root, n): the links found, as counts of linked rows and an edge to a vector of the same component."""
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not size[0]:
        return spark.createDataFrame([], "id long, root long, n long")
    bits, tables = plan(size[0], threshold, recall)
    dim = size[1]
    kind = np.float64 if "double" in dict(vectors.dtypes)["embedding"] else np.float32

    def index(batches):
        planes = directions(dim, bits, tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix(batch.column(2), dim)
                blobs = [r.tobytes() for r in x.astype(kind)]
                for table, key in enumerate(keys_of(x, planes, bits).T):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), table, dtype=np.int32)), pa.array(key), batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["table", "key", "id", "mult", "vector"])

    rows = arrow(vectors.select("id", "mult", "embedding"), index, "table int, key long, id long, mult long, vector binary")
    # Vectors move once for each table: only groups of over a tile are looked up, and there is one for each tile at most.
    large = checkpoint(rows.groupBy("table", "key").agg(F.count("*").alias("size")).where(F.col("size") > tile).select(F.col("table").alias("t"), F.col("key").alias("k"), F.ceil(F.col("size") / F.lit(tile)).cast("int").alias("tiles")))
    looked = F.broadcast(large) if large.count() * 24 <= SMALL else large
    rows = rows.join(looked, (rows["table"] == looked["t"]) & (rows["key"] == looked["k"]), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # One number for the table and the two tiles keeps rows short.
    pair = F.col("table") * F.lit(1 << 40).cast("long") + F.least("tile", "other") * F.lit(1 << 20).cast("long") + F.greatest("tile", "other")
    rows = rows.select("key", pair.alias("pair"), "id", "mult", "tile", "vector").repartition(partitions(spark), "key", "pair").sortWithinPartitions("key", "pair")

    def compare(batches):
        planes, held, now = directions(dim, bits, tables), [], None

        def done():
            if sum(b.num_rows for b in held) < 2:
                return
            table = pa.Table.from_batches(held)
            ids, mult, own = (table[c].to_numpy() for c in ("id", "mult", "tile"))
            x = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=kind).reshape(len(ids), dim).astype(np.float64)
            signs = keys_of(x, planes, bits)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            key = (now[1] >> 40, (now[1] >> 20) & 0xFFFFF, now[1] & 0xFFFFF)
            for found in _compare(key, ids, mult, own, x, signs, threshold):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "root", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(2)]
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                key = tuple(int(c[a]) for c in columns)
                if key != now:
                    yield from done()
                    held, now = [], key
                held.append(batch.slice(a, b - a))
        yield from done()

    return arrow(rows, compare, "id long, root long, n long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept), one row per row of the input.

    Vectors link at a cosine of ``threshold`` or more; each link is found with probability ``recall`` at the threshold
    and more above it, and none below it is ever reported. Rows with equal vectors are one node and link with each
    other (repeated rows too). Vectors that are null, all zero, or hold null or non-finite components link with
    nothing, and so do rows whose vec_id is null. Shorter vectors count as padded with zeros.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64(F.lit(1), "embedding").alias("k1"), F.xxhash64(F.lit(2), "embedding").alias("k2"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    nodes = checkpoint(rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("embedding").alias("embedding")))
    found = checkpoint(links(nodes, threshold, recall, tile).groupBy("id", "root").agg(F.sum("n").alias("n")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    graph = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("component_id", "root")
    named = nodes.select("k1", "k2", "id", "mult").join(counts, "id", "left").join(graph, "id", "left")
    named = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"), F.lit(True).alias("good"))
    out = rows.select("vec_id", "k1", "k2", "good").join(named, ["k1", "k2", "good"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
