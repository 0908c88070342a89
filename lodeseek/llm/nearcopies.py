"""Near copies by the Jaccard similarity of their word shingles: SimHash and MinHash bands give candidates, the shingle sets verify them.

SimHash fingerprints that differ in at most two bits are found by deletion variants (simhash). At similarity 0.8 texts differ in
some 10 of 64 bits (up to 17 or so), and segments that then differ in at most one bit are too short to tell texts apart. For those, BANDS bands of ROWS minima each
meet with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996 at 0.8, and more above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, bounds, checkpoint, cut, flat, grams, merged, mix, partitions, signed, span_hashes
from .components import components
from .simhash import BITS, fingerprint_links

WORDS, BANDS, ROWS = 5, 20, 5
#: Members of a band beyond which it is compared tile by tile.
TILE = 1 << 11
#: Similarity as a fraction, so that it is judged in whole numbers.
NEAR = (4, 5)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles (ASCII case aside); a text of fewer words is one shingle, one without words has none."""
    data, off = flat(texts)
    data = _FOLD[data]
    starts, ends, first = bounds(data, off)
    hashes = span_hashes(data, starts, ends)
    whole, out = grams(hashes, words), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - words + 1]) if b - a >= words else grams(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def _node(s: np.ndarray) -> int:
    return int(signed(mix(mix(s).sum(dtype=np.uint64, keepdims=True)))[0])


def _fingerprint(s: np.ndarray) -> int:
    """The SimHash of a shingle set: bit b is set if it is in over half of the hashes."""
    if not len(s):
        return 0
    counts = np.concatenate([np.bincount(lane, minlength=256) @ BITS for lane in np.ascontiguousarray(s, dtype="<u8").view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits(2 * counts > len(s), bitorder="little").view("<i8")[0])


def _bands(s: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), block):
        np.minimum(least, (s[None, at : at + block] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return signed(keys)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, fp, bands) for each row: a hash of the shingle set, its size, its SimHash, and the keys of its bands."""

    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                sets = shingle_sets(part.column(1))
                bands = np.concatenate([_bands(s) for s in sets]) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.int64()), lists], names=["doc_id", "node", "n", "fp", "bands"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, node long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, hashes) for each row."""

    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                sets = shingle_sets(part.column(0))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), lists], names=["node", "hashes"])

    return arrow(docs.select(F.col("text").cast("string")), run, "node long, hashes array<long>")


def _may_be_near(a: str, b: str):
    return NEAR[1] * F.least(a, b) >= NEAR[0] * F.greatest(a, b)


def _sets_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes among ids (node)."""
    wanted = nodes.join(merged(ids), "node").select(F.col("doc").alias("doc_id"), "node")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    # Rows that share a doc_id may hold other texts: the node tells them apart.
    return checkpoint(_sets(texts).join(merged(wanted.select("node")), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose shingle sets are as similar as NEAR, as (u, v)."""
    both = pairs.join(merged(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))), "a").join(merged(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return checkpoint(both.where(sum(NEAR) * common >= NEAR[0] * (F.col("na") + F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v")))


def link_members(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the members of one band which NEAR similarity connects, beyond those that a root connects already.

    Every pair of members with different roots is compared, unless earlier links have joined them: each member outside
    the largest component is held against all members.
    """
    names, label = np.unique(root, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    joined, of, out = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), []
    order = np.argsort(-np.bincount(label, minlength=len(names))[label], kind="stable")
    largest = label[order[0]]
    for i in order.tolist():
        if label[i] == largest:
            continue
        far = (label != label[i]) & (NEAR[1] * np.minimum(sizes, sizes[i]) >= NEAR[0] * np.maximum(sizes, sizes[i]))
        if not far.any():
            continue
        at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
        common = np.bincount(of[sets[i][at] == joined], minlength=len(sets))
        for j in np.flatnonzero(far & (sum(NEAR) * common >= NEAR[0] * (sizes + sizes[i]))).tolist():
            if label[j] != label[i]:
                out.append((int(node[i]), int(node[j])))
                mine, other = label[i], label[j]
                keep, gone = (other, mine) if other == largest else (mine, other)
                label[label == gone] = keep
    return out


def _tile_links(members: DataFrame) -> DataFrame:
    """(key, tiles, node, root, hashes) -> (u, v): the roots that link_members of each key joins. Keys of over TILE members are dealt out as pairs of tiles; what leaves a task are links, fewer than its members."""
    rows = members.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["key", "ta", "tb"]
    rows = rows.select("key", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "root", "hashes")
    rows = rows.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches):
        now, held = None, []

        def done():
            root = np.concatenate([h[0] for h in held]) if held else None
            found = link_members(root, root, [x for h in held for x in h[1]]) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(4)]
            lists = batch.column(4)
            values, off = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                key = tuple(int(c[a]) for c in columns[:3])
                if key != now:
                    yield from done()
                    now, held = key, []
                held.append((columns[3][a:b].copy(), [values[off[k] : off[k + 1]].copy() for k in range(a, b)]))
        yield from done()

    return arrow(rows, run, "u long, v long")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of nodes whose fingerprints differ in at most two bits.

    A fingerprint that many nodes share is held against one of them, and so are fingerprints that differ: no pairs of all nodes are made.
    """
    held = nodes.where("n > 0").select("node", "n", "fp")
    first = checkpoint(held.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")))
    same = held.join(merged(first), "fp").where("node <> first.node").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.n").alias("na"), F.col("n").alias("nb"))
    links = fingerprint_links(first.select("fp").repartition(partitions(nodes.sparkSession), "fp"))
    side = lambda x: merged(first.select(F.col("fp").alias(f"_{x}"), F.col("first.node").alias(x), F.col("first.n").alias(f"n{x}")))
    near = links.toDF("_a", "_b").join(side("a"), "_a").join(side("b"), "_b").select("a", "b", "na", "nb")
    return same.union(near).where(_may_be_near("na", "nb"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row with a doc_id: the connected texts of similarity NEAR or more, named by the smallest doc_id.

    Equal shingle sets are one node. Nodes whose SimHash fingerprints differ in at most two bits are candidates. In each band the members are first held against one of them, the one that meets
    most others over all bands: in a large group of near copies that is the text they stem from, or one close to it.
    Bands whose members are not connected yet are then compared inside one task each, all pairs, so that none is
    left out and none leaves the task.
    """
    docs = docs.where("doc_id is not null")
    rows = checkpoint(sketches(docs))
    nodes = checkpoint(rows.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    index = nodes.where("n > 0").select("node", "n", F.explode("bands").alias("key"))
    sizes = checkpoint(index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    index = checkpoint(index.join(merged(sizes), "key"))
    meets = index.groupBy("node").agg(F.sum("members").alias("meets"))
    index = checkpoint(index.join(merged(meets), "node").select("key", "node", "n", "meets"))
    middle = checkpoint(index.groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("middle")))  # written, so that the planner can split a hot band of the join
    star = index.join(merged(middle), "key").where("node <> middle.node")
    star = star.select(F.col("middle.node").alias("a"), F.col("node").alias("b"), F.col("middle.n").alias("na"), F.col("n").alias("nb"))
    pairs = checkpoint(star.where(_may_be_near("na", "nb")).union(_simhash_pairs(nodes)).distinct())
    sets = _sets_of(docs, nodes, index.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct())
    links = _verified(sets, pairs)
    of = components(links)
    rooted = index.join(merged(of), index["node"] == of["id"], "left").select("key", "node", F.coalesce("component_id", "node").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")).where("x <> y").select("key", "tiles")
    members = checkpoint(rooted.join(merged(checkpoint(open_)), "key"))
    more = checkpoint(_tile_links(members.join(merged(sets), "node").select("key", "tiles", "node", "root", "hashes")))
    of = nodes.join(merged(of), nodes["node"] == of["id"], "left").select("node", "doc", F.coalesce("component_id", "node").alias("root"))
    if not more.isEmpty():  # few: they join components that are found already, and only these are gone through again
        graph = components(more)
        of = of.join(merged(graph), of["root"] == graph["id"], "left").select("node", "doc", F.coalesce("component_id", "root").alias("root"))
    named = of.join(merged(of.groupBy("root").agg(F.min("doc").alias("component_id"))), "root").select("node", "component_id")
    return rows.join(merged(named), "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their group: one document of each group. Rows with a null doc_id stay."""
    first = groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
