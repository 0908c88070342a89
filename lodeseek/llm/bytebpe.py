"""Byte-level BPE encoding and decoding over Arrow batches, with the ``tokenizers`` library and a file of ranks."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, flat
from .tokens import SLICE, ChunkEncoder, rank_tokenizer, read_ranks

RANKS = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(rank_tokenizer(path), spaced=True)


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode_bytes(ids, path: str) -> bytes:
    """The bytes of ids, through the reversed byte table; characters split over tokens come together here."""
    table = _bytes_of(path)
    return b"".join([table[i] for i in ids])


def offsets(ids, path: str) -> tuple[list[int], list[int]]:
    """For each token the first character that it has a byte of, and the end of the last one.

    A character split over several tokens belongs to each of them: their spans overlap in it.
    """
    table = _bytes_of(path)
    sizes = np.fromiter((len(table[i]) for i in ids), dtype=np.int64, count=len(ids))
    raw = np.frombuffer(decode_bytes(ids, path), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    upto = np.cumsum(sizes)
    return character[upto - sizes].tolist(), (character[upto - 1] + 1).tolist()


def encode(docs: DataFrame, path: str | None = None, with_offsets: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids array<int>), with_offsets also char_start and char_end array<int>.

    Whole texts, without special tokens; a null or empty text has no ids, and repeated rows are each returned.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part in cut(batch, "text", SLICE):
                ids, first, *_ = coder.batch(*flat(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                arrays, names = [part.column(0), lists], ["doc_id", "ids"]
                if with_offsets:
                    spans = [offsets(x, path) for x in lists.to_pylist()]
                    arrays += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                    names += ["char_start", "char_end"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    extra = ", char_start array<int>, char_end array<int>" if with_offsets else ""
    return arrow(docs.select("doc_id", F.col("text").cast("string")), run, "doc_id long, ids array<int>" + extra)


def decode(encoded: DataFrame, path: str | None = None, errors: str = "replace") -> DataFrame:
    """(doc_id, ids array<int>, ...) -> (doc_id, decoded binary, text string); bytes that are no UTF-8 follow ``errors`` in text. Null ids decode to nothing."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        for batch in batches:
            raw = [decode_bytes(x or (), path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", errors) for x in raw], pa.string())], names=["doc_id", "decoded", "text"])

    return arrow(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, encoded and decoded again in one pass over the Arrow batches."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        coder, digits = encoder(path), [b"%d" % i for i in range(len(_bytes_of(path)))]
        for batch in batches:
            for part in cut(batch, "text", SLICE):
                ids, first, *_ = coder.batch(*flat(part.column(1)))
                made, back = [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = ids[a:b].tolist()
                    made.append(hashlib.sha256(b",".join([digits[i] for i in own])).hexdigest())
                    back.append(hashlib.sha256(decode_bytes(own, path)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(made, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


