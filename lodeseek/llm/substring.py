"""Substring dedup with prefix-partitioned suffix trees.

Every suffix of every document that has ``width`` words or more is represented by its prefix of ``width`` words. The
suffixes are split into groups by a signature of that prefix: its least hash of some consecutive words, eight at first.
It depends on the prefix alone, so suffixes with equal prefixes always share a group, and neighbouring suffixes mostly
share it too and travel together as one stretch of text. Groups whose suffixes all stem from one document cannot
repeat and are left out before any text moves. Equal stretches are one string of their group, which its smallest document
stands for: only that one's text is sent, however many copies there are, and a group of a single string needs no text.

A group whose strings take more than LIMIT bytes is split by signatures of variable length: the same suffixes are
signed anew by 16 words of their prefix, then 32, then all of it, until a group fits. (By the whole prefix a group is a
single string.) For that the input is read again, and a task finds the suffixes of large groups by their signatures: only
these go to the tasks, one for more than LIMIT bytes of text, and no text is shuffled however many times groups are split.
Each group that fits becomes the top of a suffix tree in the memory of one task: its suffixes are
sorted by prefix doubling on word numbers, without hashes. In that order an internal node is an interval of suffixes,
and the deep ones, of ``width`` words, are the intervals of equal rank; the smallest document below a deep node is what
its suffixes are held against. Maximal repeats are the unions of the windows below deep nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, arrow, bounds, checkpoint, cut, flat, grams, partitions, range_hashes, signed, span_hashes, text_key, window_minima

WIDTH = 50
SEED = 8
#: Bytes of the distinct strings in a group, beyond which it is split; some ten times as many are held while its tree grows.
LIMIT = 4 << 20
#: Suffixes in a stretch, at most: a run of one repeated word would be one stretch without end.
MOST = 1 << 12


def _stretches(part: pa.RecordBatch, width: int, seed: int, inside_of: tuple[tuple[int, np.ndarray], ...] = ()):
    """The words of a batch (doc_id, _row_key, text) and its stretches: signature, text hash, first suffix and their number, by row.

    inside_of: earlier seeds, each with signatures in order; only suffixes count that have one of these at every such seed.
    """
    data, off = flat(part.column(2))
    starts, ends, first = bounds(data, off)
    hashes = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(part.num_rows), np.diff(first))
    count = max(0, len(row) - width + 1)
    wanted = row[:count] == row[len(row) - count :]
    inside = np.flatnonzero(wanted)

    def signed_by(words: int) -> np.ndarray:
        signature = grams(hashes, words)
        return signature[window_minima(signature, width - words + 1)[inside]] if len(inside) else np.zeros(0, np.uint64)

    for words, large in inside_of:
        own = signed(signed_by(words))
        inside = inside[large[np.minimum(np.searchsorted(large, own), len(large) - 1)] == own]
    keys = signed_by(seed)
    new = np.ones(len(inside), dtype=bool)
    if len(inside):
        # By the signature and not its place: in a run of one repeated word each suffix selects a place of its own.
        new[1:] = (keys[1:] != keys[:-1]) | (inside[1:] != inside[:-1] + 1)
        run = np.flatnonzero(new)
        new |= (np.arange(len(inside)) - np.repeat(run, np.diff(np.append(run, len(inside))))) % MOST == 0
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(inside)))
    lead = inside[heads]
    last = lead + sizes + width - 2
    text = range_hashes(hashes, lead, last + 1)
    return starts, ends, first, row[lead], signed(keys[heads]), signed(text), lead, sizes, last


def _ranks(words: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """The rank of each suffix by its first ``width`` words, by prefix doubling: equal for equal prefixes. valid: where a suffix may start."""
    rank, have = words.astype(np.int64), 1
    while have < width:
        step = min(have, width - have)
        keep = np.flatnonzero(valid) if have + step == width else np.arange(len(rank) - step)
        pair = rank[keep] * (int(rank.max(initial=0)) + 1) + rank[keep + step]
        _, ids = np.unique(pair, return_inverse=True)
        rank = np.zeros(len(rank), dtype=np.int64)
        rank[keep] = ids
        have += step
    return rank


def _trees(table: pa.Table, width: int) -> pa.RecordBatch:
    """Rows (key, h, lo, text), whole groups of distinct strings -> (key, h, runs): for the suffixes of each string the smallest document below their deep node, as runs (o, n, least)."""
    data, off = flat(table["text"])
    starts, ends, first = bounds(data, off)
    buffer = np.zeros(2 * len(starts) + 1, dtype=np.int64)
    buffer[0:-1:2], buffer[1:-1:2] = starts, ends
    buffer[-1] = ends[-1]
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(buffer), pa.py_buffer(np.ascontiguousarray(data))])
    words = pieces.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode().indices.to_numpy()
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    count = len(words) - width + 1
    valid = np.zeros(len(words), dtype=bool)
    valid[:count] = row[:count] == row[width - 1 :]
    suffix = np.flatnonzero(valid)
    rank = _ranks(words, valid, width)[suffix]
    # The leaves in order, and the intervals of equal rank among them: the deep nodes.
    leaves = np.argsort(rank, kind="stable")
    nodes = np.flatnonzero(np.concatenate(([True], np.diff(rank[leaves]) != 0)))
    least = np.empty(len(suffix), dtype=np.int64)
    low = np.minimum.reduceat(table["lo"].to_numpy()[row[suffix[leaves]]], nodes)
    least[leaves] = np.repeat(low, np.diff(np.append(nodes, len(leaves))))
    own = row[suffix]
    heads = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (least[1:] != least[:-1]))))
    sizes = np.diff(np.append(heads, len(suffix)))
    runs = pa.StructArray.from_arrays([pa.array((suffix[heads] - first[own[heads]]).astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(least[heads])], names=["o", "n", "least"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[heads], np.arange(len(off))).astype(np.int32)), runs)
    return pa.RecordBatch.from_arrays([table["key"].combine_chunks(), table["h"].combine_chunks(), lists], names=["key", "h", "runs"])


def _whole_groups(batches, size: int = BLOCK):
    """Tables of whole groups of equal key from batches sorted by key, about ``size`` bytes of text each, one group at least."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        for part in cut(batch, "text", size):
            if not part.num_rows:
                continue
            keys = part.column(0).to_numpy()
            if held and held_bytes >= size:
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                split = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                if split:
                    held.append(part.slice(0, split))
                if split < len(keys):
                    yield pa.Table.from_batches(held)
                    held, held_bytes, part = [], 0, part.slice(split)
                else:
                    continue
            held.append(part)
            held_bytes += part.column(3).nbytes
    if held:
        yield pa.Table.from_batches(held)


def _found(texts: DataFrame, width: int, seed: int, inside_of: tuple = ()) -> DataFrame:
    """texts (doc_id, _row_key, text) -> its stretches (key, h, doc_id, _row_key, w0, n, size); size is in bytes. inside_of: as in _stretches, the signatures broadcast."""

    def scan(batches):
        large = tuple((words, sent.value) for words, sent in inside_of)
        for batch in batches:
            for part in cut(batch, "text"):
                starts, ends, first, row, keys, text, lead, sizes, last = _stretches(part, width, seed, large)
                at = pa.array(row)
                size = ends[last] - starts[lead] if len(lead) else lead
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(text), part.column(0).take(at), part.column(1).take(at), pa.array((lead - first[row]).astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(size.astype(np.int32))], names=["key", "h", "doc_id", "_row_key", "w0", "n", "size"])

    return arrow(texts, scan, "key long, h long, doc_id long, _row_key long, w0 int, n int, size int")


def _of_documents(base: DataFrame, lists: DataFrame) -> DataFrame:
    """base (doc_id, _row_key, text) with the list that belongs to each row; rows without one are left out."""
    lists = lists.toDF("_id", "_key", "list")
    return base.join(lists, (base["doc_id"] == lists["_id"]) & (base["_row_key"] == lists["_key"])).select("doc_id", "_row_key", "text", "list")


def _written(df: DataFrame) -> DataFrame:
    """A checkpoint of rows that are dealt out evenly, in few files: where a file's mode is set by a program, each file starts several from the executor."""
    spark = df.sparkSession
    return checkpoint(df.coalesce(max(4 * spark.sparkContext.defaultParallelism, partitions(spark) // 8)))


def _strings(found: DataFrame, shared: DataFrame) -> DataFrame:
    """The strings (key, h, doc_id, _row_key, w0, n, size) of the shared groups, each where it first stands.

    They are grouped by another form of the key: by the key itself they would be grouped where they were joined, and the planner could not
    split a hot signature there.
    """
    keyed = found.join(shared, "key").withColumn("key", F.bitwise_not("key"))
    strings = keyed.groupBy("key", "h").agg(F.min(F.struct("doc_id", "_row_key", "w0")).alias("first"), F.max("n").alias("n"), F.max("size").alias("size"))
    return strings.select(F.bitwise_not("key").alias("key"), "h", "first.*", "n", "size")


def repeated_windows(docs: DataFrame, width: int = WIDTH, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """(doc_id, _row_key, runs array<struct<w0 long, n long>>): suffixes (by their first word) whose first ``width`` words also start one of a smaller document."""
    base = docs.select("doc_id", "_row_key", "text")
    found, hits, wanted, plain, inside_of = _found(base, width, seed), [], [], [], ()
    while True:
        # Both sides of these joins are dealt out anew, so that the adaptive planner can split a hot signature.
        shared = _written(found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"))
        strings = _written(_strings(found, shared))
        sizes = _written(strings.groupBy("key").agg(F.count("*").alias("strings"), F.sum("size").alias("bytes")))
        strings = strings.join(sizes, "key")
        large = (F.col("strings") > 1) & (F.col("bytes") > limit) if seed < width else F.lit(False)
        hits.append(found)  # found anew rather than written: what is known of its strings picks those of shared groups
        plain.append(strings.where("strings = 1").select("key", "h", F.array(F.struct(F.lit(0).alias("o"), "n", F.col("doc_id").alias("least"))).alias("runs")))
        wanted.append(strings.where((F.col("strings") > 1) & ~large))
        # Each stands for more than ``limit`` bytes of distinct text, so that they are few.
        again = np.array([r[0] for r in sizes.where((F.col("strings") > 1) & (F.col("bytes") > limit)).select("key").collect()], dtype=np.int64) if seed < width else ()
        if not len(again):
            break
        inside_of += ((seed, docs.sparkSession.sparkContext.broadcast(np.sort(again))),)
        seed = min(2 * seed, width)
        found = checkpoint(_found(base, width, seed, inside_of))  # written: a small part of all suffixes, for two readers

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def send(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                data, off = flat(part.column(2))
                starts, ends, first = bounds(data, off)
                lists = part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                some = lists.flatten()
                a = first[row] + some.field("w0").to_numpy()
                s, e = starts[a], ends[a + some.field("n").to_numpy() + width - 2]
                raw = data.tobytes()
                sent = pa.array([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())
                out = pa.RecordBatch.from_arrays([some.field("key"), some.field("h"), part.column(0).take(pa.array(row)), sent], names=["key", "h", "lo", "text"])
                yield from cut(out, "text")

    lists = union(wanted).groupBy("doc_id", "_row_key").agg(F.collect_list(F.struct("key", "h", "w0", "n")).alias("list"))
    texts = arrow(_of_documents(base, lists), send, "key long, h long, lo long, text binary")
    texts = texts.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key")

    def grow(batches):
        for table in _whole_groups(batches):
            yield _trees(table, width)

    known = union([arrow(texts, grow, "key long, h long, runs array<struct<o:int,n:int,least:long>>"), *plain])
    rows = union(hits).join(known, ["key", "h"]).select("doc_id", "_row_key", "w0", F.explode("runs").alias("r")).where("r.least < doc_id")
    place = F.struct((F.col("w0").cast("long") + F.col("r.o")).alias("w0"), F.col("r.n").cast("long").alias("n"))
    return rows.groupBy("doc_id", "_row_key").agg(F.collect_list(place).alias("runs"))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id long, text, ...) -> (doc_id, n_words, n_removed, kept binary): the words left, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word is removed if a window of ``width`` consecutive words of its document
    covers it whose word sequence also starts in a document with a smaller doc_id. A null or empty text has no
    words; texts under ``width`` words lose none. Rows that share a doc_id are one document: they never remove each
    other's words. Rows with a null doc_id are neither compared nor changed; repeated rows are each returned.
    """
    docs = text_key(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    # In the same order of columns as where the strings are sent from: the texts are then dealt out once for both.
    some = docs.where("doc_id is not null").select("doc_id", "_row_key", "text")
    hits = repeated_windows(some, width, seed, limit).withColumnRenamed("doc_id", "_id").withColumnRenamed("_row_key", "_key")
    joined = some.join(hits, (some["doc_id"] == hits["_id"]) & (some["_row_key"] == hits["_key"]), "left").select("doc_id", "text", "runs")
    joined = joined.union(docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<w0:long,n:long>>").alias("runs")))

    def apply(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                n_words, n_removed, kept = [], [], []
                for text, runs in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    n_words.append(len(words))
                    if runs:
                        cover = np.zeros(len(words) + 1, dtype=np.int64)
                        w0, n = np.array([r["w0"] for r in runs]), np.array([r["n"] for r in runs])
                        np.add.at(cover, w0, 1)
                        np.add.at(cover, w0 + n + width - 1, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return arrow(joined, apply, "doc_id long, n_words long, n_removed long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    """The columns of the contract: the kept words as a SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, for tests."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
