"""Shared pieces: checkpoints on the shared folder, Arrow batches cut by bytes, and word hashing in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout: runs without ASCII white space.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, tidy

#: Bytes of text that the numpy code handles at once; one longer document is hashed in blocks of this size.
BLOCK = 1 << 20
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_MULT = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster names.

    Where none is named, a folder of this machine serves while driver and executors are one process (``local[n]``); on a
    cluster it is an error, as executors could not share it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """The side of a join that must not go whole through the driver, however small the planner takes it to be.

    It sizes a table by the files and columns that it comes from, as if an explode, a join or Python made no more rows of them. Joined
    by sorting, hot keys are still split.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by as many underscores as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow of a function that uses this package, for columns of any name."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches):
        try:
            yield from function(b.rename_columns(names) for b in batches)
        finally:
            tidy()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MULT ** i and its inverse modulo 2**64, for i below n at least."""
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("pow", _MULT), ("inv", pow(_MULT, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array and the offsets of its rows; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=width, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def cut(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in the column each, one row at least."""
    _, off = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of the first word (one more entry at the end). space: which bytes part words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), which ascend without overlap; equal ranges get equal hashes wherever they stand."""
    key = f"bytes{seed}"
    if key not in _tables:
        _tables[key] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 0x632BE5AB))
    table, out, i = _tables[key], np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        top = int(ends[j - 1])
        power, inverse = _powers(top - base + 1)
        sums = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(table[data[base:top]] * power[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) of 64-bit values; starts ascend, and so do ends, and ranges may overlap. Equal ranges get equal hashes wherever they stand."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        top = int(ends[j - 1])
        power, inverse = _powers(top - base + 1)
        sums = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(values[base:top] * power[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def grams(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash of each n consecutive hashes (those that cross rows too: the caller leaves them out)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, factor, power = np.zeros(count, dtype=np.uint64), (0x2545F4914F6CDD1D + 2 * seed) | 1, 1
    for k in range(n):
        out += hashes[k : k + count] * np.uint64(power)
        power = power * factor % (1 << 64)
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its leftmost minimum, by doubling."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    at, have = np.arange(len(values), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        have += step
    return at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _row_key, a hash of the text: with doc_id it tells rows apart that share an id."""
    return df.withColumn("_row_key", F.xxhash64(F.col(text)))
