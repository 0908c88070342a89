"""Toxicity by a classifier chain: the categories are predicted one after the other, and each linear model also sees
the probabilities of the earlier ones. The later models are trained with out-of-fold probabilities, so that they
learn from predictions as uncertain as those they meet afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, bounds, cut, flat, span_hashes

CATEGORIES = ("quality", "toxic")
BUCKETS = 1 << 20
#: Bytes of the word beginnings that are features beside the words.
PREFIXES = (5, 6, 7, 8)
#: Labelled documents that the chain is fitted on, at most: those with the least hash of doc_id.
SAMPLE = 3000
FOLDS = 5
#: Word buckets that a model uses, at most: those that tell the label best in training.
KEEP = 1024
_SPACE = np.ones(256, dtype=bool)
_SPACE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def word_buckets(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct bucket of each row: a bucket for each word and for its first bytes.

    Words are runs of letters and digits, ASCII lower-cased; the first bytes stand for stems. wanted: a flag for each
    bucket, to leave out the others before rows are gathered.
    """
    folded = _FOLD[data]
    starts, ends, first = bounds(folded, off, _SPACE)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    found = []
    for size in (0, *PREFIXES):
        longer = slice(None) if not size else np.flatnonzero(ends - starts > size)
        s = starts[longer]
        bucket = (span_hashes(folded, s, s + size if size else ends, 3 + size) & np.uint64(BUCKETS - 1)).astype(np.int64)
        r = row[longer]
        if wanted is not None:
            use = wanted[bucket]
            bucket, r = bucket[use], r[use]
        found.append(r * BUCKETS + bucket)
    pairs = np.unique(np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Linear:
    """Logistic model on the presence of some buckets and on dense features."""

    buckets: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def logits(self, row: np.ndarray, bucket: np.ndarray, rows: int, dense: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.buckets, bucket)
        at[at == len(self.buckets)] = 0
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        return np.bincount(row[hit], self.weights[at[hit]], minlength=rows) + dense @ self.dense + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 0.02) -> Linear:
    """Logistic regression by accelerated gradient steps on the buckets whose presence changes the label's odds most."""
    n, pos = max(1, len(y)), max(1.0, y.sum())
    neg = max(1.0, n - y.sum())
    seen = np.bincount(bucket, minlength=BUCKETS)
    in_pos = np.bincount(bucket, y[row], minlength=BUCKETS)
    often = np.flatnonzero(seen >= 3)
    a, b = in_pos[often], seen[often] - in_pos[often]
    gain = np.abs(a / pos - b / neg) / np.sqrt((a + b + 1) / n * (1 / pos + 1 / neg))
    keep = np.sort(often[np.argsort(-gain, kind="stable")[:KEEP]])
    at = np.full(BUCKETS, -1)
    at[keep] = np.arange(len(keep))
    used = at[bucket] >= 0
    r, c = row[used], at[bucket[used]]
    scale = np.abs(np.log(((in_pos[keep] + 0.5) / (pos + 1)) / ((seen[keep] - in_pos[keep] + 0.5) / (neg + 1))))
    w, v = np.zeros(len(keep) + dense.shape[1] + 1), np.zeros(len(keep) + dense.shape[1] + 1)
    w[-1] = v[-1] = np.log(pos / neg)
    k = len(keep)
    load = np.bincount(r, scale[c] ** 2, minlength=n).max(initial=0) + (dense**2).sum(axis=1).max(initial=0) + 1
    rate = 4 / load
    for t in range(steps):
        g = _sigmoid(np.bincount(r, scale[c] * v[c], minlength=n) + dense @ v[k:-1] + v[-1]) - y
        # Rare labels weigh as much as frequent ones in the gradient's size, not in the base rate.
        grad = np.concatenate((np.bincount(c, scale[c] * g[r], minlength=k), dense.T @ g, [g.sum()]))
        grad[:-1] += ridge * v[:-1] * 50
        new = v - rate * grad / max(1.0, n**0.5)
        v = new + t / (t + 3) * (new - w)
        w = new
    return Linear(keep, w[:k] * scale, w[k:-1], float(w[-1]))


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]

    def wanted(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=bool)
        for model in self.models:
            out[model.buckets] = True
        return out

    def probabilities(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, 0))
        for model in self.models:
            out = np.column_stack((out, _sigmoid(model.logits(row, bucket, rows, _logit(out)))))
        return out


def _rows_of(row: np.ndarray, bucket: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, bucket) pairs of the rows flagged in ``some``, numbered anew."""
    use = some[row]
    return (np.cumsum(some) - 1)[row[use]], bucket[use]


def fit_chain(row: np.ndarray, bucket: np.ndarray, labels: np.ndarray, categories=CATEGORIES, folds: int = FOLDS) -> Chain:
    """labels: 0, 1 or NaN (not known) for each row and category. The dense inputs of a model are the earlier categories' out-of-fold logits.

    A model is fitted on the rows whose label is known; rows that it has not seen get its own prediction as theirs.
    """
    rows, models, dense = len(labels), [], np.zeros((len(labels), 0))
    for k in range(len(categories)):
        known = ~np.isnan(labels[:, k])
        y = np.where(known, labels[:, k], 0.0)
        fold = np.where(known, (np.cumsum(known) - 1) % folds, -1)
        models.append(fit_linear(*_rows_of(row, bucket, known), dense[known], y[known]))
        if k + 1 < len(categories):
            out = np.zeros(rows)
            for f in range(-1, folds):
                test = fold == f
                if test.any():
                    train = known & ~test
                    part = models[-1] if f < 0 else fit_linear(*_rows_of(row, bucket, train), dense[train], y[train])
                    out[test] = part.logits(*_rows_of(row, bucket, test), int(test.sum()), dense[test])
            dense = np.column_stack((dense, _logit(_sigmoid(out))))
    return Chain(tuple(categories), models)


def _features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                row, bucket = word_buckets(*flat(part.column(1)))
                off = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(bucket.astype(np.int32)))], names=["doc_id", "buckets"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, buckets array<int>")


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> Chain | None:
    """Fits a chain on at most ``sample`` labelled documents, those with the least hash of doc_id; None if there is none.

    A null label is not known: the document is left out for that category only, and wholly if it has none. Where
    several rows label one document, the greatest value counts; where several rows have its doc_id, the least text.
    """
    ints = [F.col(c).cast("int").alias(c) for c in categories]
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *ints).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    known = known.where(F.coalesce(*categories).isNotNull())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not chosen:
        return None
    table = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, " + ", ".join(f"`{c}` int" for c in categories))
    # The sample is bounded, so the few labelled documents are picked out of the scan without moving the others.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(table.select("doc_id")), "doc_id")
    found = _features(texts.groupBy("doc_id").agg(F.min("text").alias("text"))).collect()
    if not found:
        return None
    of = {r["doc_id"]: [np.nan if r[c] is None else float(r[c] > 0) for c in categories] for r in chosen}
    place = {r["doc_id"]: k for k, r in enumerate(chosen)}
    found.sort(key=lambda r: place[r["doc_id"]])
    row = np.repeat(np.arange(len(found)), [len(r["buckets"]) for r in found])
    bucket = np.concatenate([np.array(r["buckets"], dtype=np.int64) for r in found])
    return fit_chain(row, bucket, np.array([of[r["doc_id"]] for r in found]), categories)


def score(docs: DataFrame, chain: Chain | None, categories=CATEGORIES) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, p_<category> double for each, toxic_pred boolean: the last category's probability is 0.5 or more).

    Whole texts; a null or empty text is scored by the base rates alone. Repeated rows get equal results, an empty table
    gives an empty one, and columns other than doc_id and text play no part. Without a chain (no labels) all
    probabilities are 0.
    """

    def run(batches):
        wanted = chain.wanted() if chain else None
        for batch in batches:
            for part in cut(batch, "text"):
                if chain is None:
                    p = np.zeros((part.num_rows, len(categories)))
                else:
                    p = chain.probabilities(*word_buckets(*flat(part.column(1)), wanted), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= 0.5)], names=["doc_id", *[f"p_{c}" for c in categories], "toxic_pred"])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + ", toxic_pred boolean"
    return arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
