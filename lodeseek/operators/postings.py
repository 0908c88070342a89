"""Posting lists as coded blocks: unions and intersections work on the codes, and a long list is many rows.

Ids are cut at their lower 16 bits. What a list has of one span of 65,536 ids is a row: up to 4,096 ids as sorted 16-bit numbers, more
as a bitmap of 8 kB. So no row grows with the data, lists meet span by span, and a hot cluster's spans lie in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SPAN, SPARSE = 1 << 16, 4096
CODED = "key long, span long, n int, data binary"


def _bitmap(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(SPAN, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little")


def code(low: np.ndarray) -> bytes:
    """Sorted different numbers below SPAN as a row's data."""
    return low.astype("<u2").tobytes() if len(low) <= SPARSE else _bitmap(low).tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    """The n sorted numbers of a row."""
    return np.frombuffer(data, "<u2").astype(np.int64) if n <= SPARSE else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def _bits(data: bytes, n: int) -> np.ndarray:
    return _bitmap(decode(data, n)) if n <= SPARSE else np.frombuffer(data, np.uint8)


def _of_bits(bits: np.ndarray) -> tuple[int, bytes]:
    n = int(np.bitwise_count(bits).sum())
    return n, bits.tobytes() if n > SPARSE else code(np.flatnonzero(np.unpackbits(bits, bitorder="little")))


def either(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    """The union of coded rows: few numbers are merged as they are, many as bitmaps."""
    if sum(n for n, _ in rows) <= SPARSE:
        low = np.unique(np.concatenate([decode(d, n) for n, d in rows]))
        return len(low), code(low)
    bits = np.zeros(SPAN // 8, dtype=np.uint8)
    for n, d in rows:
        bits |= _bits(d, n)
    return _of_bits(bits)


def both(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, bytes]:
    """The intersection of two coded rows: a short one is looked up in the other."""
    (n, d), (m, e) = sorted((a, b), key=lambda x: x[0])
    if n > SPARSE:
        return _of_bits(_bits(d, n) & _bits(e, m))
    low = decode(d, n)
    kept = low[(np.frombuffer(e, np.uint8)[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)] if m > SPARSE else np.intersect1d(low, decode(e, m), assume_unique=True)
    return len(kept), code(kept)


def _made(rows: DataFrame, pieces: Callable[[pa.RecordBatch, int, int], list], join: Callable[[list], tuple[int, bytes]]) -> DataFrame:
    """rows (key, span, ...) -> CODED: ``join`` of what ``pieces`` takes from the runs of rows of each group. Groups come together in a task; 64 pieces at most are held apart."""
    rows = rows.repartition("key", "span").sortWithinPartitions("key", "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "span", "n", "data"])

        for batch in batches:
            key, span = (batch.column(k).to_numpy() for k in (0, 1))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (span[1:] != span[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
                if a == b:
                    continue
                if (key[a], span[a]) != now:
                    if held:
                        out.append((int(now[0]), int(now[1]), *join(held)))
                    now, held = (key[a], span[a]), []
                    if len(out) >= 256:
                        yield flush()
                        out = []
                held += pieces(batch, a, b)
                if len(held) > 64:
                    held = [join(held)]
        if held:
            out.append((int(now[0]), int(now[1]), *join(held)))
        if out:
            yield flush()

    return B.arrow(rows, run, CODED)


def posting_blocks(assigned: DataFrame) -> DataFrame:
    """(token_id, cluster_id) -> CODED, key being the cluster. Repeated ids count once; null ids and clusters are left out. Ids may be any long."""
    rows = assigned.where("token_id is not null and cluster_id is not null")
    rows = rows.select(F.col("cluster_id").cast("long").alias("key"), F.shiftright(F.col("token_id").cast("long"), 16).alias("span"), F.col("token_id").cast("long").bitwiseAND(F.lit(SPAN - 1).cast("long")).alias("low"))

    def pieces(batch: pa.RecordBatch, a: int, b: int) -> list[tuple[int, bytes]]:
        low = np.unique(batch.column(2).to_numpy()[a:b])
        return [(len(low), code(low))]

    return _made(rows, pieces, either)


def union_of(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """CODED lists by query: of all clusters that wanted (query_id, cluster_id) names for it."""
    named = wanted.select(F.col("query_id").cast("long").alias("_q"), F.col("cluster_id").cast("long").alias("_c")).distinct()
    rows = postings.join(named, F.col("key") == F.col("_c")).select(F.col("_q").alias("key"), "span", "n", "data")

    def pieces(batch: pa.RecordBatch, a: int, b: int) -> list[tuple[int, bytes]]:
        some = batch.slice(a, b - a)
        return list(zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True))

    return _made(rows, pieces, either)


def intersection_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """CODED lists of what both have under a key; a key that has nothing in common is left out."""
    right = b.select(F.col("key").alias("_key"), F.col("span").alias("_span"), F.col("n").alias("m"), F.col("data").alias("other"))
    rows = a.join(right, (F.col("key") == F.col("_key")) & (F.col("span") == F.col("_span"))).select("key", "span", "n", "data", "m", "other")

    def run(batches):
        for batch in batches:
            key, span, *rest = [c.to_pylist() for c in batch.columns]
            made = [both((n, d), (m, e)) for n, d, m, e in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(span, pa.int64()), pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], names=["key", "span", "n", "data"])

    return B.arrow(rows, run, CODED).where("n > 0")


def ids_of(coded: DataFrame) -> DataFrame:
    """CODED -> (key, id)."""

    def run(batches):
        for batch in batches:
            for key, span, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                low = decode(data, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), key)), pa.array((span << 16) + low)], names=["key", "id"])

    return B.arrow(coded, run, "key long, id long")
