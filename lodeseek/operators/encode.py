"""Text encoders behind one interface. The default needs no model: each token is a fixed random direction."""

from __future__ import annotations

import hashlib
import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .blocks import appended, arrow
from .lazy import Lazy, loaded
from .text import tokenized


class Encoder(Protocol):
    """Vectors of a token list, one row each. A large model is passed as Lazy, so that workers load it themselves.

    One with a true attribute ``pointwise`` gives a token the same vector whatever stands beside it.
    """

    dim: int

    def vectors(self, tokens: list[str]) -> np.ndarray: ...


class HashEncoder:
    """The unit vector of a token is drawn from a generator seeded by the token's CRC-32."""

    pointwise = True

    def __init__(self, dim: int = 64, seed: int = 42):
        self.dim, self.seed, self.known = dim, seed, {}

    def _one(self, token: str) -> np.ndarray:
        v = self.known.get(token)
        if v is None:
            v = np.random.default_rng((self.seed, zlib.crc32(token.encode()))).standard_normal(self.dim)
            v /= np.linalg.norm(v)
            if len(self.known) < 100_000:
                self.known[token] = v
        return v

    def vectors(self, tokens: list[str]) -> np.ndarray:
        return np.array([self._one(t) for t in tokens]).reshape(len(tokens), self.dim)


class DigestEncoder:
    """32 components: the hexadecimal digits of the token's MD5, less their mean, as a unit vector. Any system that has MD5 can make the same vectors."""

    dim, pointwise = 32, True

    def vectors(self, tokens: list[str]) -> np.ndarray:
        digits = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in tokens), dtype=np.uint8).reshape(-1, 16)
        v = np.stack((digits >> 4, digits & 15), axis=2).reshape(-1, 32) - 7.5
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _encode(rows: DataFrame, encoder: Encoder | Lazy, pooled: bool) -> DataFrame:
    """rows (doc_id, tokens array) -> (doc_id, pos, vec), or (doc_id, vec) pooled."""

    def run(batches):
        model = loaded(encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(1).to_pylist()
                found = [np.asarray(model.vectors(tokens or []), dtype=np.float64).reshape(-1, model.dim) for tokens in lists]
                if pooled:
                    sums = np.array([v.sum(axis=0) for v in found])
                    found = list((sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12))[:, None, :])
                sizes = [len(v) for v in found]
                flat = np.concatenate(found)
                vecs = pa.ListArray.from_arrays(pa.array((np.arange(len(flat) + 1) * model.dim).astype(np.int32)), pa.array(flat.ravel()))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
                pos = pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, vecs] if pooled else [ids, pos, vecs], names=["doc_id", "vec"] if pooled else ["doc_id", "pos", "vec"])

    kept = rows.select("doc_id")
    return arrow(rows, run, appended(kept, "vec array<double>" if pooled else "pos int, vec array<double>"))


def _tokens(docs: DataFrame, marker: str, tokenizer) -> DataFrame:
    return tokenized(docs.select("doc_id", T.marked(F.coalesce(F.col("text"), F.lit("")), marker).alias("text")), tokenizer=tokenizer)


def encode_docs(docs: DataFrame, encoder: Encoder | Lazy | None = None, max_len: int = 180, tokenizer=None) -> DataFrame:
    """(doc_id, text) -> (doc_id, pos, vec): marker and words, truncated, special tokens dropped, unit vectors. tokenizer: see tokenized."""
    tokens = T.drop_ends(T.with_specials(T.truncate(F.col("tokens"), max_len)))
    return _encode(_tokens(docs, "[D] ", tokenizer).select("doc_id", tokens.alias("tokens")), encoder or HashEncoder(), pooled=False)


def encode_queries(queries: DataFrame, encoder: Encoder | Lazy | None = None, max_len: int | None = 32, augment: bool = False, tokenizer=None) -> DataFrame:
    """(query_id, text) -> (query_id, q_tok, qvec): augment pads with MASK up to max_len, so that every query has max_len - 2 vectors. max_len None: whole texts, with a vector for each token."""
    if augment and max_len is None:
        raise ValueError("only a length can be filled up")
    words = F.col("tokens")
    tokens = words if max_len is None else T.keep_mask(T.pad(words, max_len)) if augment else T.drop_ends(T.with_specials(T.truncate(words, max_len)))
    rows = _tokens(queries.select(F.col("query_id").alias("doc_id"), "text"), "[Q] ", tokenizer)
    out = _encode(rows.select("doc_id", tokens.alias("tokens")), encoder or HashEncoder(), pooled=False)
    return out.select(F.col("doc_id").alias("query_id"), F.col("pos").alias("q_tok"), F.col("vec").alias("qvec"))


def encode_single(docs: DataFrame, encoder: Encoder | Lazy | None = None, tokenizer=None) -> DataFrame:
    """(doc_id, text) -> (doc_id, vec): one unit vector for each text; a text without words has the zero vector."""
    return _encode(tokenized(docs, tokenizer=tokenizer), encoder or HashEncoder(), pooled=True)
