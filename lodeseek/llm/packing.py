"""Packing of tokenised documents into sequences: best fit, then a local search by swaps.

Documents are cut into pieces of at most ``capacity`` tokens (only longer ones are cut). Pieces are dealt into
groups of a bounded number, and each group is packed in the memory of one task: best fit in the order of arrival (of a
hash) gives a first packing, and the local search then drains the emptiest bins: it moves documents between underfull
bins and exchanges one for one or two for one wherever that increases the sum of squared fills, until bins are empty.
What the search can't place stays in the emptiest bin of each group. These bins are opened again and their documents
packed together, group by group, until one group is left, so that the number of groups costs no sequences.

The search ends for a group when it has as few bins as its tokens need, or when PASSES passes over its SOURCES emptiest
bins in a row have emptied none; every bin with room is searched as a target.
"""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import arrow, checkpoint, cut, flat
from .tokens import SLICE, ChunkEncoder, file_tokenizer

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
#: Documents whose pieces are packed together in one task.
GROUP = 8192
#: Bins that the local search tries to empty in a pass, the emptiest first, and passes in a row that may empty none.
SOURCES, PASSES = 64, 8


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(file_tokenizer(path), spaced=False)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, _row long, piece int, start long, length long, ids_crc32 long): each text's ids, then END, cut every ``capacity`` ids. Null texts count as empty. _row numbers the rows of a partition."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        coder, before = encoder(path), 0
        for batch in batches:
            for part in cut(batch, "text", SLICE):
                ids, first, *_ = coder.batch(*flat(part.column(1)))
                ids = np.insert(ids.astype("<u4"), first[1:], END)
                first = first + np.arange(len(first))
                lengths = np.diff(first)
                count = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(lengths[row] - start, capacity)
                at = first[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(before + row), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "_row", "piece", "start", "length", "ids_crc32"])
                before += part.num_rows

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow(rows, run, "doc_id long, _row long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in the order given: bins of places in lengths, by the fullest bin that still takes each."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    for i, size in enumerate(lengths):
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([])
            b, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[b].append(i)
        room -= size
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append(b)
    return bins


class _Search:
    """Bins as arrays: the bin of each document, and each bin's fill."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.size, self.capacity = np.array(lengths, dtype=np.int64), capacity
        self.bin = np.zeros(len(lengths), dtype=np.int64)
        for k, b in enumerate(bins):
            self.bin[b] = k
        self.fill = np.bincount(self.bin, self.size, minlength=len(bins)).astype(np.int64)

    def put(self, i: int, target: int) -> None:
        self.fill[self.bin[i]] -= self.size[i]
        self.fill[target] += self.size[i]
        self.bin[i] = target

    def place(self, i: int) -> bool:
        """Moves document i, or exchanges it for one or two smaller ones, into a bin at least as full as its own that it makes fuller."""
        source, size = int(self.bin[i]), int(self.size[i])
        room = self.capacity - self.fill
        open_ = (self.fill >= self.fill[source]) & (room > 0)
        open_[source] = False
        fits = np.flatnonzero(open_ & (room >= size))
        if len(fits):
            self.put(i, int(fits[np.argmin(room[fits])]))
            return True
        near = np.flatnonzero(open_[self.bin])
        if not len(near):
            return False
        own, least, where = self.size[near], size - room[self.bin[near]], self.bin[near]
        gain = size - own
        gain[(gain <= 0) | (own < least)] = 0
        best = int(gain.argmax())
        if gain[best]:
            self.put(int(near[best]), source)
            self.put(i, int(where[best]))
            return True
        # Two for one: for each document the smallest other one of its bin that makes enough room.
        wide = self.capacity + 1
        order = np.argsort(where * wide + own, kind="stable")
        near, own, where, least = near[order], own[order], where[order], least[order]
        keys = where * wide + own
        at = np.searchsorted(keys, where * wide + np.maximum(least - own, 0))
        at += at == np.arange(len(keys))
        ok = at < len(keys)
        other = np.where(ok, at, 0)
        gain = np.where(ok & (where[other] == where), size - own - own[other], 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            return False
        target = int(where[best])
        self.put(int(near[best]), source)
        self.put(int(near[other[best]]), source)
        self.put(i, target)
        return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, sources: int = SOURCES, passes: int = PASSES) -> list[list[int]]:
    """Moves and swaps between underfull bins that increase the squared fill, until no bin more can be emptied.

    Each step makes a fuller bin fuller at the cost of an emptier one, so the sum of squares grows and the search ends.
    """
    state, least, idle = _Search(bins, lengths, capacity), -(-sum(lengths) // capacity), 0
    while idle < passes and (left := int((state.fill > 0).sum())) > least:
        changed = False
        some = np.flatnonzero((state.fill > 0) & (state.fill < capacity))
        for source in some[np.lexsort((some, state.fill[some]))][:sources].tolist():
            docs = np.flatnonzero(state.bin == source)
            for i in docs[np.lexsort((docs, -state.size[docs]))].tolist():
                changed |= state.place(i)
            if int((state.fill > 0).sum()) <= least:
                break
        idle = 0 if int((state.fill > 0).sum()) < left else idle + 1
        if not changed:
            break
    order = np.argsort(state.bin, kind="stable")
    cuts = np.flatnonzero(np.diff(state.bin[order])) + 1
    return [b.tolist() for b in np.split(order, cuts)] if len(order) else []


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, _row, piece, start, length, ids_crc32) -> without _row, with sequence_id and offset.

    About ``group`` pieces share a task. A piece of full length has a sequence of its own.
    """
    ship(rows.sparkSession)

    def packer(level: int, last: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["_hash", "doc_id", "_row", "piece"], ignore_index=True)
            lengths = frame["length"].to_numpy()
            full = np.flatnonzero(lengths == capacity).tolist()
            rest = np.flatnonzero(lengths < capacity)
            sizes = lengths[rest].tolist()
            bins = [rest[b].tolist() for b in local_search(best_fit(sizes, capacity), sizes, capacity)]
            bins.sort(key=lambda b: (-int(lengths[b].sum()), b[0]))
            sequence, offset, left = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
            base = (level << 56) + (int(frame["_group"].iloc[0]) << 24)
            for k, b in enumerate([[i] for i in full] + bins):
                sequence[b] = base + k
                offset[b] = np.cumsum(lengths[b]) - lengths[b]
            if bins and not last and lengths[bins[-1]].sum() < capacity:
                left[bins[-1]] = True
            return frame.drop(columns=["_group"]).assign(sequence_id=sequence, offset=offset, _open=left)

        return run

    # Texts of all kinds come together in each group, whatever doc_id or text repeats: the hash is over the row and piece.
    rows = rows.withColumn("_hash", F.xxhash64("doc_id", "_row", "piece", "ids_crc32"))
    closed, level, groups = [], 0, None
    while True:
        groups = max(1, min(-(-rows.count() // group), groups // 2 if groups else 1 << 31))
        dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_hash", F.lit(level)), F.lit(groups)).cast("int"))
        packed = dealt.groupBy("_group").applyInPandas(packer(level, groups == 1), _PACKED + ", _row long, _hash long, _open boolean")
        if groups == 1:
            closed.append(packed)
            break
        packed = checkpoint(packed)
        closed.append(packed.where("not _open"))
        rows = packed.where("_open").drop("sequence_id", "offset", "_open")
        level += 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("_row", "_hash", "_open")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the one token END. A special token's own string in a text is that token, as the library
    reads it. Repeated rows are each packed, in different groups too; an empty table gives no rows; rows
    whose doc_id is null are packed like others.
    """
    return pack(checkpoint(pieces(docs, capacity, path)), capacity, group)
