"""Vectors and codes in packed blocks: matrix products, nearest rows and table lookups in numpy over Arrow batches.

A block is one row of a DataFrame with some thousand vectors (or codes) in a binary column. Joins pair blocks with
blocks, so neither their rows nor their number grow with pairs of vectors, and one product does the work of a pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..runtime import ship, tidy

#: Vectors in a block, about: one megabyte at 64 components.
ROWS = 2048
#: Query vectors in a block, about.
QUERY_ROWS = 512
#: Rows that are scored at once, about.
NEAR = 256
#: Bytes of a table that go to all executors, at most; beyond, both sides of a join are dealt out.
BROADCAST = 64 << 20
#: Decimals of scores before ranks are given.
DIGITS = 6
#: Bytes of bounds that a task keeps of vectors it has met before.
KEPT = 64 << 20
#: Norm of vectors up to which bounds hold; blocks with longer ones are scored in full.
UNIT = 1.001
#: Tokens of a query that are looked for first where all of them are asked for.
PILOTS = 2
#: Vectors whose distinct ones are stored once, about.
SHARED = 1 << 18
#: Where a DataFrame of blocks keeps the rows it is packed from, and the function that packs them.
_PACKS = "_lodeseek_packs"


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, for columns of any name.

    What pack has made is packed where it is used: a worker passes each block on inside the same pass, so that no second worker
    is held for a task and none gets a batch of many blocks, which would grow with the table.
    """
    ship(df.sparkSession)
    df, before = df.__dict__.get(_PACKS, (df, None))
    names = df.columns

    def run(batches):
        try:
            named = (b.rename_columns(names) for b in batches)
            yield from function(before(named) if before else named)
        finally:
            tidy()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def shape(df: DataFrame, column: str) -> tuple[int, int | None]:
    """Rows, and components of the vectors in a column; None if there is none."""
    n, dim = df.agg(F.count("*"), F.max(F.size(column))).first()
    return n, dim


def width(df: DataFrame, column: str) -> int | None:
    """Components of the vectors in a column; None if there is none."""
    return shape(df, column)[1]


def dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an array column as a matrix, and their places: rows that are null, have another number of components or a null among them are left out."""
    sizes = np.diff(column.offsets.to_numpy())
    keep = (sizes == dim) & ~np.asarray(column.is_null())
    flat = column.flatten()
    if keep.all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(keep), dim), np.arange(len(keep))
    keep &= np.array([x is None or None not in x for x in column.to_pylist()], dtype=bool)
    at = np.flatnonzero(keep)
    rows = column.take(pa.array(at))
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(at), dim), at


def _slices(batches: Iterator[pa.RecordBatch], size: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _named(at: np.ndarray, values, names: list[pa.Array]) -> tuple[np.ndarray, np.ndarray | list]:
    """Those of the places and values whose row has none of its ids null."""
    keep = np.flatnonzero(~np.any([np.asarray(c.is_null())[at] for c in names], axis=0))
    return at[keep], values[keep] if isinstance(values, np.ndarray) else [values[k] for k in keep.tolist()]


def pack(rows: DataFrame, dim: int | None, size: int = ROWS, single: bool = False) -> DataFrame:
    """(key long, id long, sub long, value, ...) -> (key, ids binary, subs binary, data binary[, more binary]): blocks of one key and about ``size`` rows.

    Rows of one id in a partition are never parted if they stand together; rows without a key or id, or without a
    complete value, are left out. value: vectors of ``dim`` doubles, or codes
    as binaries of equal length if dim is None. single: vectors are kept in single precision. A fifth column of doubles
    travels along.
    """
    more, kind = len(rows.columns) > 4, np.float32 if single else np.float64

    def run(batches):
        now, held, count = None, [], 0

        def done():
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *[pa.array([b"".join(h[k] for h in held)], pa.binary()) for k in range(len(held[0]))]], names=["key", "ids", "subs", "data", "more"][: len(held[0]) + 1])

        last = None
        for batch in _slices(batches):
            if dim is None:
                at = np.flatnonzero(~np.asarray(batch.column(3).is_null()))
                values = batch.column(3).take(pa.array(at)).to_pylist()
            else:
                values, at = dense(batch.column(3), dim)
            names = batch.columns[:3]
            if any(c.null_count for c in names):
                at, values = _named(at, values, names)
            key, ids, subs = (c.fill_null(0).to_numpy(zero_copy_only=False)[at] for c in names)
            extra = batch.column(4).to_numpy(zero_copy_only=False)[at].astype(np.float64) if more else None
            new_key = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            new_id = np.append(np.flatnonzero((key[1:] != key[:-1]) | (ids[1:] != ids[:-1])) + 1, len(key))
            a = 0
            while a < len(key):
                if now != key[a] or count >= size and last != ids[a]:
                    yield from done()
                    now, held, count = int(key[a]), [], 0
                b = int(new_key[np.searchsorted(new_key, a, side="right")])
                b = min(b, int(new_id[np.searchsorted(new_id, min(len(key), a + max(1, size - count)))]))
                last = ids[a:b][-1]
                data = b"".join(values[a:b]) if dim is None else values[a:b].astype(kind, copy=False).tobytes()
                held.append((ids[a:b].tobytes(), subs[a:b].tobytes(), data, *([extra[a:b].tobytes()] if more else [])))
                count += b - a
                a = b
        yield from done()

    out = arrow(rows, run, "key long, ids binary, subs binary, data binary" + (", more binary" if more else ""))
    setattr(out, _PACKS, (rows, run))
    return out


def compacted(packed: DataFrame) -> DataFrame:
    """Blocks (key, ids, subs, data) to be stored: (keys, sizes, ids, subs, runs, places, vectors), some blocks a row, each distinct vector of theirs once, and ids and subs as runs. expanded gives the same blocks again."""

    def run(batches):
        held, count = [], 0

        def done():
            if held:
                keys, sizes = np.array([h[0] for h in held], np.int64), np.array([len(h[1]) // 8 for h in held], np.int64)
                data = b"".join(h[3] for h in held)
                vectors, places = np.unique(np.frombuffer(data, np.dtype((np.void, len(data) // int(sizes.sum())))), return_inverse=True)
                ids, subs = (np.frombuffer(b"".join(h[k] for h in held), np.int64) for k in (1, 2))
                heads = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1]))))
                columns = [keys, sizes, ids[heads], subs[heads], np.diff(np.append(heads, len(ids))), places.astype(np.int32), vectors]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["keys", "sizes", "ids", "subs", "runs", "places", "vectors"])

        for batch in batches:
            for block in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("key", "ids", "subs", "data")], strict=True):
                held.append(tuple(x.as_py() for x in block))
                count += len(held[-1][1]) // 8
                if count >= SHARED:
                    yield from done()
                    held, count = [], 0
        yield from done()

    return arrow(packed, run, "keys binary, sizes binary, ids binary, subs binary, runs binary, places binary, vectors binary")


def expanded(stored: DataFrame) -> DataFrame:
    """The blocks (key, ids, subs, data) of compacted, made one at a time where they are used."""

    def run(batches):
        for batch in batches:
            for row in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("keys", "sizes", "ids", "subs", "runs", "places", "vectors")], strict=True):
                *longs, places, vectors = (x.as_py() for x in row)
                keys, sizes, ids, subs, runs = (np.frombuffer(x, np.int64) for x in longs)
                ids, subs, places = np.repeat(ids, runs), np.repeat(subs, runs), np.frombuffer(places, np.int32)
                vectors = np.frombuffer(vectors, np.dtype((np.void, len(vectors) // (int(places.max()) + 1))))
                ends = np.cumsum(sizes).tolist()
                for key, a, b in zip(keys.tolist(), [0, *ends[:-1]], ends, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *[pa.array([x], pa.binary()) for x in (ids[a:b].tobytes(), subs[a:b].tobytes(), vectors[places[a:b]].tobytes())]], names=["key", "ids", "subs", "data"])

    out = arrow(stored, run, "key long, ids binary, subs binary, data binary")
    setattr(out, _PACKS, (stored, run))
    return out


def every_pair(large: DataFrame, small: DataFrame, size: int) -> DataFrame:
    """Every block of large with every block of small (its columns lead by q): broadcast if small has few bytes, else large is dealt out to shares and each share meets all of small. size: bytes of small's vectors."""
    small = small.select(*[F.col(c).alias(f"q{c}") for c in small.columns])
    if size <= BROADCAST:
        return large.crossJoin(F.broadcast(small))
    shares = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = large.withColumn("_share", F.pmod(F.xxhash64("key", "ids", "subs"), F.lit(shares)).cast("int"))
    return left.join(small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), "_share").drop("_share")


def of_key(large: DataFrame, small: DataFrame) -> DataFrame:
    """The pairs of blocks that share their key. The planner broadcasts the smaller side if it is small, and splits hot keys."""
    return large.join(small.select("key", *[F.col(c).alias(f"q{c}") for c in small.columns if c != "key"]), "key")


def vectors_of(data: bytes, n: int, dim: int) -> np.ndarray:
    """The n vectors of a block, in double precision or, where they were stored so, in single."""
    return np.frombuffer(data, dtype=np.float32 if len(data) == 4 * n * dim else np.float64).reshape(n, dim)


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


class Products:
    """Inner products of a block's vectors with the query vectors."""

    def __init__(self, dim: int):
        self.dim = dim

    def rows(self, data: bytes, n: int) -> np.ndarray:
        """The block's n rows as a matrix."""
        return vectors_of(data, n, self.dim)

    def of(self, x: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return (x @ queries.T.astype(x.dtype, copy=False)).astype(np.float64, copy=False)

    def scores(self, data: bytes, n: int, queries: np.ndarray) -> np.ndarray:
        return self.of(self.rows(data, n), queries)


class Distances(Products):
    """Squared distances of a block's vectors from the query vectors."""

    def of(self, x: np.ndarray, queries: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64, copy=False)
        return np.maximum((x * x).sum(axis=1)[:, None] + (queries * queries).sum(axis=1) - 2 * x @ queries.T, 0)


class Lookups(Products):
    """Sums of table entries: for each part the inner product of the query's part with the codeword that the code names.

    codebooks: (parts, codewords, components). The table of a block of queries is made once and kept while it is used.
    """

    def __init__(self, codebooks: np.ndarray):
        self.books, self.dim, self._of, self._table = codebooks, codebooks.shape[0] * codebooks.shape[2], None, None

    def rows(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, dtype=np.uint8).reshape(n, len(self.books))

    def of(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        if self._of is not queries:  # kept, so that no other array can take its place
            parts = queries.reshape(len(queries), len(self.books), -1)
            self._table, self._of = np.einsum("qmd,mkd->mkq", parts, self.books, optimize=True), queries
        out = np.zeros((len(codes), len(queries)))
        for m in range(len(self.books)):
            out += self._table[m][codes[:, m]]
        return out


class Shared(Products):
    """Products of vectors that many rows share, such as centroids: a row is the place of its vector, in four bytes, and each product with a block of queries is made once."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.dim, self._of, self._table = vectors, vectors.shape[1], None, None

    def rows(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, dtype=">i4")

    def of(self, places: np.ndarray, queries: np.ndarray) -> np.ndarray:
        if self._of is not queries:
            self._table, self._of = self.vectors @ queries.T, queries
        return self._table[places]


class Residuals(Lookups):
    """Lookups of residual codes, led by four bytes with the place of the row's centroid: its product with the query vector is added."""

    def __init__(self, codebooks: np.ndarray, centroids: np.ndarray):
        super().__init__(codebooks)
        self.terms = Shared(centroids)

    def rows(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, dtype=np.uint8).reshape(n, 4 + len(self.books))

    def of(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return super().of(codes[:, 4:], queries) + self.terms.of(np.ascontiguousarray(codes[:, :4]).view(">i4")[:, 0], queries)


def _joined(batches: Iterator[pa.RecordBatch], kernel: Products):
    """(ids, subs, query ids, query subs, data, query vectors) of each pair of blocks in joined rows."""
    for batch in batches:
        names = batch.schema.names
        for row in zip(*[batch.column(names.index(c)) for c in ("ids", "subs", "data", "qids", "qsubs", "qdata")], strict=True):
            ids, subs, data, qids, qsubs, qdata = (x.as_py() for x in row)
            yield np.frombuffer(ids, np.int64), np.frombuffer(subs, np.int64), np.frombuffer(qids, np.int64), np.frombuffer(qsubs, np.int64), data, np.frombuffer(qdata).reshape(-1, kernel.dim)


@dataclass
class Pairs:
    """Every block of ``large`` with every block of ``small``, whose vectors have ``size`` bytes.

    Up to BROADCAST bytes the small blocks go to all tasks once and are paired with a block where it is: nothing is joined, and a task holds
    its own blocks and one copy of the small ones. Beyond, the rows are joined (every_pair).
    """

    large: DataFrame
    small: DataFrame
    size: int

    def apply(self, function: Callable[[Iterator], Iterator[pa.RecordBatch]], kernel: Products, schema: str) -> DataFrame:
        """function of the pairs of each task, as _joined gives them."""
        if self.size > BROADCAST:
            return arrow(every_pair(self.large, self.small, self.size), lambda batches: function(_joined(batches, kernel)), schema)
        sent, dim = self.large.sparkSession.sparkContext.broadcast([tuple(r) for r in self.small.select("ids", "subs", "data").collect()]), kernel.dim

        def pairs(batches):
            asked = [(np.frombuffer(i, np.int64), np.frombuffer(t, np.int64), np.frombuffer(d).reshape(-1, dim)) for i, t, d in sent.value]
            for batch in batches:
                names = batch.schema.names
                for row in zip(*[batch.column(names.index(c)) for c in ("ids", "subs", "data")], strict=True):
                    ids, subs, data = (x.as_py() for x in row)
                    for qids, qsubs, q in asked:
                        yield np.frombuffer(ids, np.int64), np.frombuffer(subs, np.int64), qids, qsubs, data, q

        return arrow(self.large, lambda batches: function(pairs(batches)), schema)


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that are few bytes but much work, dealt out (by columns) over more tasks than cores, whatever the files of their table."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *columns)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded half away from zero, as SQL does."""
    y = x * 10.0**digits
    out = np.trunc(y + np.copysign(0.5, y)) / 10.0**digits + 0.0
    return out if not y.size or np.abs(y).max() < 2.0**52 else np.where(np.abs(y) < 2.0**52, out, x)


def all_scores(pairs: Pairs, kernel: Products, columns: tuple[str, ...] = ("query_id", "q_tok", "doc_id", "token_id", "s"), digits: int | None = None) -> DataFrame:
    """(query_id, q_tok, doc_id, token_id, s) of every vector and query vector of the pairs of blocks, or some of these columns; s is rounded to ``digits``.

    Rows leave a task some ten thousand at a time.
    """
    kinds = {"query_id": "long", "q_tok": "int", "doc_id": "long", "token_id": "long", "s": "double"}

    def run(found):
        for ids, subs, qids, qsubs, data, q in found:
            rows, qsubs, step = kernel.rows(data, len(ids)), qsubs.astype(np.int32), max(1, (1 << 16) // max(1, len(qids)))
            for a in range(0, len(ids), step):
                s = kernel.of(rows[a : a + step], q)
                n, k = s.shape
                make = {"query_id": lambda: np.tile(qids, n), "q_tok": lambda: np.tile(qsubs, n), "doc_id": lambda: np.repeat(ids[a : a + n], k), "token_id": lambda: np.repeat(subs[a : a + n], k), "s": lambda: (s if digits is None else rounded(s, digits)).reshape(-1)}
                yield pa.RecordBatch.from_arrays([pa.array(make[c]()) for c in columns], names=list(columns))

    return pairs.apply(run, kernel, ", ".join(f"{c} {kinds[c]}" for c in columns))


class _Top:
    """The best documents of each query so far, by rounded score and id."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        shown = np.round(scores, DIGITS)
        for c, query in enumerate(queries.tolist()):
            s, d, raw = shown[:, c], docs, scores[:, c]
            if query in self.found:
                old = self.found[query]
                some = s >= old[0][-1] if len(old[0]) == self.k else slice(None)
                s, d, raw = (np.concatenate((a, b[some])) for a, b in zip(old, (s, d, raw), strict=True))
                if len(s) == len(old[0]):
                    continue
            if len(s) > 4 * self.k:
                some = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, d, raw = s[some], d[some], raw[some]
            order = np.lexsort((d, -s))[: self.k]
            self.found[query] = (s[order], d[order], raw[order])

    def rows(self):
        if self.found:
            sizes = [len(x[0]) for x in self.found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(self.found), np.int64), sizes)), pa.array(np.concatenate([x[1] for x in self.found.values()])), pa.array(np.concatenate([x[2] for x in self.found.values()]))], names=["query_id", "doc_id", "score"])
            self.found = {}


def _best(kernel: Products, rows: np.ndarray, queries: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The best score of each document, whose rows begin at heads, for each query vector; some documents at a time, so that their scores stay near the processor."""
    out, a = np.empty((len(heads), len(queries))), 0
    ends = np.append(heads[1:], len(rows))
    while a < len(heads):
        b = max(a + 1, int(np.searchsorted(ends, heads[a] + NEAR, side="right")))
        out[a:b] = np.maximum.reduceat(kernel.of(rows[heads[a] : ends[b - 1]], queries), heads[a:b] - heads[a], axis=0)
        a = b
    return out


class _Lists:
    """The queries of some blocks as lists of distinct vectors; queries that ask for the same list are answered together."""

    def __init__(self, asked: list[tuple[bytes, bytes, bytes]], dim: int):
        found: dict[bytes, list[int]] = {}
        x = np.concatenate([np.frombuffer(d).reshape(-1, dim) for *_, d in asked]) if asked else np.zeros((0, dim))
        self.vectors, of = np.unique(x, axis=0, return_inverse=True)
        of, at = of.reshape(-1), 0
        for ids, *_ in asked:
            ids = np.frombuffer(ids, np.int64)
            heads = _heads(ids)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)], strict=True):
                found.setdefault(of[at + a : at + b].tobytes(), []).append(int(ids[a]))
            at += len(ids)
        self.lists, self.ids = [np.frombuffer(k, of.dtype) for k in found], list(found.values())
        self.flat = np.concatenate(self.lists) if found else of[:0]
        self.first = np.cumsum([0, *map(len, self.lists)])[:-1]

    def best(self, kernel: Products, rows: np.ndarray, lists: list[int]) -> list[np.ndarray]:
        """For each of the lists the best score of each of its vectors among the rows."""
        wanted, at = np.unique(np.concatenate([self.lists[i] for i in lists]), return_inverse=True)
        queries = self.vectors[wanted]
        step = max(1, (1 << 20) // len(wanted))
        best = np.max([np.maximum.reduce(kernel.of(rows[a : a + step], queries), axis=0) for a in range(0, len(rows), step)], axis=0)
        return np.split(best[at.reshape(-1)], np.cumsum([len(self.lists[i]) for i in lists])[:-1])


class _Bounds:
    """Upper bounds of the products of unit vectors with the query vectors, in bytes.

    Texts repeat most of their tokens, so those of a vector that comes a second time are kept, up to KEPT bytes. A document's bound is
    then the greatest byte of its vectors for each query vector, summed over a query: many times cheaper than the products.
    """

    def __init__(self, lists: _Lists):
        self.lists, n = lists, len(lists.vectors)
        self.unit = UNIT * float(np.sqrt((lists.vectors**2).sum(axis=1).max())) / 255 or 1.0
        self.queries = np.ascontiguousarray(lists.vectors.T / self.unit, dtype=np.float32)
        self.kept = np.empty((max(1, KEPT // n), n), dtype=np.uint8)
        self.at: dict[bytes, int] = {}
        self.used = 0
        self.met: set[int] = set()

    @staticmethod
    def above(s: np.ndarray) -> np.ndarray:
        """Whole numbers above the products, and above what single precision may lack."""
        return np.clip(s + np.float32(1.001), 0, 255).astype(np.uint8)

    def most(self, x: np.ndarray) -> np.ndarray:
        """The greatest bounds of some vectors."""
        data, wide = x.tobytes(), x.shape[1] * x.itemsize
        keys = [data[a : a + wide] for a in range(0, len(data), wide)]
        slots = np.array([self.at.get(k, -1) for k in keys])
        known, new = slots[slots >= 0], np.flatnonzero(slots < 0)
        out = np.maximum.reduce(self.kept[known], axis=0) if len(known) else np.zeros(len(self.queries.T), dtype=np.uint8)
        for at in range(0, len(new), 64):
            some = new[at : at + 64]
            s = x[some].astype(np.float32) @ self.queries
            np.maximum(out, self.above(np.maximum.reduce(s, axis=0)), out=out)
            if self.used < len(self.kept):
                marks = [hash(keys[i]) for i in some.tolist()]
                again = [j for j, mark in enumerate(marks) if mark in self.met][: len(self.kept) - self.used]
                self.met.update(marks)
                if again:
                    self.kept[self.used : self.used + len(again)] = self.above(s[again])
                    self.at.update(zip([keys[some[j]] for j in again], range(self.used, self.used + len(again)), strict=True))
                    self.used += len(again)
        if len(self.met) > 200_000:
            self.met.clear()
        return out

    def of(self, rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """(documents, lists): no score of a document, whose rows begin at heads, for a list is greater."""
        ends, best = np.append(heads[1:], len(rows)), np.zeros((len(heads), len(self.lists.vectors)), dtype=np.uint8)
        for i, (a, b) in enumerate(zip(heads.tolist(), ends.tolist(), strict=True)):
            for at in range(a, b, 4 * NEAR):
                np.maximum(best[i], self.most(rows[at : min(b, at + 4 * NEAR)]), out=best[i])
        return np.add.reduceat(best[:, self.lists.flat], self.lists.first, axis=1, dtype=np.int64) * self.unit


def _pilots(lists: _Lists) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(query vectors, for each list the places of its own among them, the norms of the others summed): those vectors of each list that fewest lists have."""
    common = np.bincount(np.concatenate([np.unique(x) for x in lists.lists]), minlength=len(lists.vectors))
    norms = np.sqrt((lists.vectors**2).sum(axis=1))
    first = [np.argsort(common[x], kind="stable")[:PILOTS] for x in lists.lists]
    chosen = [x[f] for x, f in zip(lists.lists, first, strict=True)]
    wanted = np.unique(np.concatenate(chosen))
    return lists.vectors[wanted], [np.searchsorted(wanted, c) for c in chosen], np.array([norms[x].sum() - norms[c].sum() for x, c in zip(lists.lists, chosen, strict=True)])


def searched(packed: DataFrame, asked: DataFrame, dim: int, part: int, k: int | None = None, share: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, best array<double>) of blocks of whole documents, and of parts of documents under the key ``part``, in one pass.

    asked: blocks of whole queries of a checked size, which go to all tasks. Of whole documents score is set: with k of the rows that may be
    among a query's k best, with share of those that reach it. They are told apart by bounds first, and only documents whose bound
    reaches what is asked for get their products. Of parts best is set, for each query vector.
    """
    sent, kernel = packed.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.select("ids", "subs", "data").collect()]), Products(dim)

    def batch_of(queries, docs, scores, best=None):
        n = len(queries)
        return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.float64()), pa.nulls(n, pa.list_(pa.float64())) if best is None else pa.array(best, pa.list_(pa.float64()))], names=["query_id", "doc_id", "score", "best"])

    def run(batches):
        lists = _Lists(sent.value, dim)
        if not lists.ids:
            return
        every, bounds = np.arange(len(lists.ids)), _Bounds(lists) if k else None
        best: list[list[tuple[float, int, float]]] = [[] for _ in lists.ids]
        least = np.full(len(lists.ids), -np.inf) if share is None else share * np.array([len(x) for x in lists.lists])
        if share is not None:
            pilots, places, others = _pilots(lists)
            pilots = pilots.T.astype(np.float32)

        def reached(rows: np.ndarray, heads: np.ndarray, norm: float) -> np.ndarray:
            if k:
                return bounds.of(rows, heads) if norm <= UNIT else np.full((len(heads), len(every)), np.inf)
            if share is None:
                return np.full((len(heads), len(every)), np.inf)
            out = np.empty((len(heads), len(every)))
            for i, (a, b) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True)):
                top = np.max([np.maximum.reduce(rows[at : at + 4 * NEAR].astype(np.float32) @ pilots, axis=0) for at in range(a, b, 4 * NEAR)], axis=0)
                out[i] = [top[p].sum() for p in places]
            return out + others * norm + 1e-4 * (1 + norm)

        for batch in batches:
            for key, ids, data in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("key", "ids", "data")], strict=True):
                ids = np.frombuffer(ids.as_py(), np.int64)
                rows = kernel.rows(data.as_py(), len(ids))
                heads = _heads(ids)
                ends = np.append(heads[1:], len(ids))
                if key.as_py() == part:
                    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
                        for i, x in enumerate(lists.best(kernel, rows[a:b], every.tolist())):
                            yield batch_of(lists.ids[i], [int(ids[a])] * len(lists.ids[i]), [None] * len(lists.ids[i]), [x] * len(lists.ids[i]))
                    continue
                bound = reached(rows, heads, float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max())))
                for d, (a, b) in enumerate(zip(heads.tolist(), ends.tolist(), strict=True)):
                    some = np.flatnonzero(~(bound[d] < least - 1e-5)).tolist()
                    if not some:
                        continue
                    doc, scores = int(ids[a]), [float(x.sum()) for x in lists.best(kernel, rows[a:b], some)]
                    if not k:
                        rows_of = [(q, s) for i, s in zip(some, scores, strict=True) if share is None or s >= least[i] for q in lists.ids[i]]
                        if rows_of:
                            yield batch_of([q for q, _ in rows_of], [doc] * len(rows_of), [s for _, s in rows_of])
                        continue
                    for i, s in zip(some, scores, strict=True):
                        entry, held = (round(s, DIGITS), -doc, s), best[i]
                        if len(held) < k:
                            heapq.heappush(held, entry)
                        else:
                            heapq.heappushpop(held, entry)
                        if len(held) == k:
                            least[i] = held[0][0]
        for i, held in enumerate(best):
            for q in lists.ids[i] if held else []:
                yield batch_of([q] * len(held), [-h[1] for h in held], [h[2] for h in held])

    return arrow(packed, run, "query_id long, doc_id long, score double, best array<double>")


def whole_scores(pairs: Pairs, kernel: Products, k: int | None = None, share: float | None = None) -> DataFrame:
    """(query_id, doc_id, score) from blocks that hold whole documents and whole queries: for each query vector the best document vector, summed.

    k: only rows that may be among a query's k best. share: only scores of at least this share of the number of query vectors.
    """

    def run(found):
        top = _Top(k) if k else None
        for ids, _, qids, _, data, q in found:
            heads, qheads = _heads(ids), _heads(qids)
            best = _best(kernel, kernel.rows(data, len(ids)), q, heads)
            scores, docs, queries = np.add.reduceat(best, qheads, axis=1), ids[heads], qids[qheads]
            if top is None:
                least = -np.inf if share is None else share * np.diff(np.append(qheads, len(qids)))
                d, c = np.nonzero(scores >= least)
                yield pa.RecordBatch.from_arrays([pa.array(queries[c]), pa.array(docs[d]), pa.array(scores[d, c])], names=["query_id", "doc_id", "score"])
                continue
            top.add(queries, docs, scores)
            if len(top.found) > 100_000:
                yield from top.rows()
        if top is not None:
            yield from top.rows()

    return pairs.apply(run, kernel, "query_id long, doc_id long, score double")


def part_scores(pairs: DataFrame, kernel: Products) -> DataFrame:
    """(query_id, doc_id, rank int, best array<double>) from blocks of parts of documents: for each query vector the best vector of the document in the block.

    The queries' ``more`` column has, for each query vector, a value that is added to its scores (a centroid's part), and
    their ``subs`` its number times 2^32 plus the rank at which the query probes the block.
    """

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            terms = batch.column(names.index("qmore"))
            for at, (ids, _, qids, qsubs, data, q) in enumerate(_joined(iter([batch]), kernel)):
                heads, qheads = _heads(ids), _heads(qids)
                best = np.maximum.reduceat(kernel.scores(data, len(ids), q), heads, axis=0) + np.frombuffer(terms[at].as_py())
                docs, queries, ranks = ids[heads], qids[qheads], (qsubs[qheads] & 0xFFFFFFFF).astype(np.int32)
                each = np.tile(np.diff(np.append(qheads, len(qids))), len(docs))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), pa.array(best.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(queries, len(docs))), pa.array(np.repeat(docs, len(queries))), pa.array(np.tile(ranks, len(docs))), lists], names=["query_id", "doc_id", "rank", "best"])

    return arrow(pairs, run, "query_id long, doc_id long, rank int, best array<double>")


def summed(lists: str):
    """Of a column of lists of bests the greatest of each query vector, summed."""
    best = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def combine(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """part_scores (by..., query_id, doc_id, best) -> (by..., query_id, doc_id, score): the greatest of each query vector over all parts, summed."""
    lists = parts.groupBy(*by, "query_id", "doc_id").agg(F.collect_list("best").alias("all"))
    return lists.select(*by, "query_id", "doc_id", summed("all").alias("score"))


def nearest(x: np.ndarray, c: np.ndarray, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the place of the nearest row of c, and the squared distance rounded to ``digits``; ties of rounded distances go to the first."""
    d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T
    at = d.argmin(axis=1)
    low = d[np.arange(len(x)), at]
    # The product form is inexact: rows with several candidates within its error are decided by plain differences.
    close = np.flatnonzero((d <= (low + 1e-6 * (1 + np.abs(low)))[:, None]).sum(axis=1) > 1)
    for some in np.array_split(close, max(1, -(-len(close) * c.size // (1 << 22)))):
        at[some] = np.round(((x[some, None, :] - c) ** 2).sum(axis=2), digits).argmin(axis=1)
    return at, np.round(((x - c[at]) ** 2).sum(axis=1), digits)


def project(df: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """df with the vectors of a column times a matrix (components, new components), as array<double>; incomplete vectors become null."""
    matrix, columns = np.asarray(matrix, dtype=np.float64), df.columns
    place = columns.index(column)

    def run(batches):
        for batch in _slices(batches):
            x, at = dense(batch.column(place).cast(pa.list_(pa.float64())), matrix.shape[0])
            y = x @ matrix
            take = np.full(batch.num_rows, -1)
            take[at] = np.arange(len(at))
            rows = pa.ListArray.from_arrays(pa.array((np.arange(len(y) + 1) * matrix.shape[1]).astype(np.int32)), pa.array(y.ravel()))
            arrays = list(batch.columns)
            arrays[place] = rows.take(pa.array(take, mask=take < 0))
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    fields = [f if f.name != column else StructType.fromDDL("x array<double>").fields[0] for f in df.schema.fields]
    return arrow(df, run, StructType([StructField(n, f.dataType) for n, f in zip(columns, fields, strict=True)]))


def appended(df: DataFrame, ddl: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
