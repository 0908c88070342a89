"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most two bits have a half that
differs in at most one, so the index holds, for each half, the half itself and its 32 variants with one bit
deleted (a wildcard). An equality join of equal variants gives the candidates, and the Hamming distance of the
whole fingerprints verifies them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, checkpoint, cut, merged, partitions
from .components import components

#: Members of one signature group beyond which the group is indexed anew by a quarter of the other half.
WIDE = 256
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: bytes, words: int = 3, block: int = 1 << 18) -> int:
    """The fingerprint of a text: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of its shingles."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    ends = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        pairs = zip(starts[at : min(n, at + block)].tolist(), ends[at : at + block].tolist(), strict=True)
        lanes = np.array([digest(joined[s:e], 42) for s, e in pairs], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(lanes[:, k], minlength=256) @ BITS
    return sum(1 << b for b in range(64) if 2 * counts[b] > n)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id long, fp long) for each row; a null text has no words and so the fingerprint 0."""

    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                fps = np.array([simhash(t or b"", words) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _near(left: str, right: str, bits: int):
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right))) <= bits


def fingerprint_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a long, b long): the pairs of distinct fingerprints that differ in at most ``bits`` (0 to 2) bits.

    A wildcard variant joins only fingerprints that differ in its deleted bit, and a whole half only those that
    share it, so that few pairs meet twice. A group of over WIDE members (thousands of near copies with one half in
    common) is indexed anew: the members also have a quarter of the rest that differs in at most one bit, and that
    quarter's variants extend the key. The result is the same; no group is dropped or cut short.
    """
    half = lambda x, k: F.shiftrightunsigned(x, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def variants(value, width: int, low: int):
        """Structs (kind, key, side): the value itself, and each deletion of one bit with that bit's own value as side."""
        whole = F.struct(F.lit(low).alias("kind"), value.alias("key"), F.lit(-1).alias("side"))
        return [whole] + [F.struct(F.lit(low + 1 + i).alias("kind"), value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)).cast("long")).alias("key"), F.shiftright(value, i).bitwiseAND(F.lit(1).cast("long")).cast("int").alias("side")) for i in range(width)]

    fp = F.col("fp")
    index = fps.select("fp", F.explode(F.array(*variants(half(fp, 0), 32, 0), *variants(half(fp, 1), 32, 33))).alias("x")).select("fp", "x.*")
    sizes = index.groupBy("kind", "key").agg(F.count("*").alias("n"))
    sizes = checkpoint(sizes.where("n > 1"))  # written, so that the planner can split a hot key of the join
    index = checkpoint(index.join(merged(sizes), ["kind", "key"]))

    def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
        a = rows.select(*keys, F.col("fp").alias("a"), F.col("side").alias("sa"))
        b = rows.select(*keys, F.col("fp").alias("b"), F.col("side").alias("sb"))
        apart = ((F.col("sa") == -1) & (F.col("a") < F.col("b"))) | ((F.col("sa") == 0) & (F.col("sb") == 1))
        return a.join(merged(b), keys_equal(a, b, keys) & apart & _near("a", "b", bits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def keys_equal(a: DataFrame, b: DataFrame, keys: list[str]):
        out = a[keys[0]] == b[keys[0]]
        for k in keys[1:]:
            out = out & (a[k] == b[k])
        return out

    small = index.where(F.col("n") <= WIDE)
    wide = index.where(F.col("n") > WIDE)
    # The other half (32 bits) differs in at most two bits: one of its quarters in at most one.
    rest = F.when(F.col("kind") < 33, half(fp, 1)).otherwise(half(fp, 0))
    quarter = lambda k: F.shiftrightunsigned(rest, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))
    inner = F.explode(F.array(*variants(quarter(0), 16, 0), *variants(quarter(1), 16, 17)))
    wide = wide.select("fp", "kind", "key", "side", inner.alias("y")).select("fp", "kind", "key", "side", F.col("y.kind").alias("kind2"), F.col("y.key").alias("key2"), F.col("y.side").alias("side2"))
    a = wide.select("kind", "key", "kind2", "key2", F.col("fp").alias("a"), F.col("side").alias("sa"), F.col("side2").alias("ta"))
    b = wide.select("kind", "key", "kind2", "key2", F.col("fp").alias("b"), F.col("side").alias("sb"), F.col("side2").alias("tb"))
    outer = (F.col("sa") == F.col("sb")) & (F.col("sa") == -1) | (F.col("sa") == 0) & (F.col("sb") == 1)
    apart = ((F.col("sa") == 0) | (F.col("a") < F.col("b"))) & ((F.col("ta") == -1) & (F.col("tb") == -1) | (F.col("ta") >= 0) & (F.col("tb") >= 0) & (F.col("ta") != F.col("tb")))
    equal = (a["kind"] == b["kind"]) & (a["key"] == b["key"]) & (a["kind2"] == b["kind2"]) & (a["key2"] == b["key2"])
    split = a.join(merged(b), equal & outer & apart & _near("a", "b", bits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs(small, ["kind", "key"]).union(split).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text, ...).

    Equal fingerprints are one node (its copies need no pairs); nodes within ``bits`` bits are linked, and a
    component is named by its smallest doc_id. A null or blank text has fingerprint 0 and links like any other; a
    row whose doc_id is null keeps its place but names no component (null if it is alone). Repeated rows stay.
    """
    rows = checkpoint(fingerprints(docs, words))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # A fingerprint makes 66 rows of the index: the few bytes of the nodes are dealt out to all tasks first.
    links = fingerprint_links(nodes.select("fp").repartition(partitions(docs.sparkSession), "fp"), bits)
    graph = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Components are found over fingerprints; each is then named by its smallest doc_id.
    of = nodes.join(merged(graph), nodes["fp"] == graph["id"], "left").select("fp", "rep", F.coalesce("component_id", "fp").alias("root"))
    names = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of.join(merged(names), "root").select(F.col("fp").alias("_fp"), "component_id")
    joined = rows.join(merged(named), rows["fp"] == named["_fp"], "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """The rows of docs whose doc_id names their group: one document of each group. Rows with a null doc_id stay."""
    first = simhash_groups(docs, words, bits).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
