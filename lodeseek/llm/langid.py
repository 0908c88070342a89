"""Language identification with error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over hashed byte n-grams of the whole text
is trained (regularised least squares on the square roots of n-gram shares). A text's outputs are compared with
every codeword by a loss for each bit, weighted by how well the bit does on rows kept aside, and the language with
the least loss is chosen. The loss gap to the second says how sure it is: near-ties are flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow, cut, flat

UNKNOWN = "und"
BUCKETS = 4096
SIZES = (2, 3)
#: Labelled documents of each language that the classifiers are fitted on, at most: those with the least hash of doc_id.
SAMPLE = 400
#: Labelled documents of all languages together, at most; with many languages each has an equal share of them.
TOTAL = 8192
#: Probability gap between the two nearest codewords below which a prediction counts as ambiguous.
GAP = 0.02
_ROWS = 256
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def ngram_shares(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each row the square roots of the shares of its hashed n-grams: ASCII letters lower-cased, other ASCII as space."""
    rows, folded = len(off) - 1, _FOLD[data]
    counts = np.zeros(rows * BUCKETS, dtype=np.float64)
    row = np.repeat(np.arange(rows), np.diff(off))
    for n in SIZES:
        if len(folded) < n:
            continue
        code = np.zeros(len(folded) - n + 1, dtype=np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + folded[k : k + len(code)]
        code = (code * np.uint32(2654435761)) >> np.uint32(20)
        same = row[: len(code)] == row[n - 1 :]
        counts += np.bincount((row[: len(code)] * BUCKETS + code)[same], minlength=rows * BUCKETS)
    counts = counts.reshape(rows, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def codewords(classes: int, columns: int = 63, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each class: the exhaustive code for up to 7 classes, else the best of random dense codes."""
    if classes <= 7:
        columns_ = [c for c in itertools.product((1, -1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns_, dtype=np.float64).T.reshape(classes, -1)
    rng = np.random.default_rng(seed)
    draws = (rng.choice((-1.0, 1.0), size=(classes, columns)) for _ in range(50 if classes <= 500 else 2))
    return max(draws, key=lambda m: np.min((columns - m @ m.T + 3 * columns * np.eye(classes)) / 2))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    sharpness: float

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        """Softmax of the negative weighted losses exp(-m f) of each codeword, a few rows at a time where there are many."""
        step = max(1, (1 << 22) // max(1, self.code.size))
        if len(f) > step:
            return np.concatenate([self.probabilities(f[at : at + step]) for at in range(0, len(f), step)])
        loss = np.exp(-np.clip(f, -3, 3)[:, None, :] * self.code[None]) @ self.bit_weights
        z = -self.sharpness * (loss - loss.min(axis=1, keepdims=True))
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _least_squares(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Ridge regression through the smaller of the two normal systems: rows by rows, or features by features."""
    mean, middle = x.mean(axis=0), y.mean(axis=0)
    centred = x - mean
    if len(x) <= x.shape[1]:
        gram = centred @ centred.T
        gram[np.diag_indices_from(gram)] += ridge * len(x)
        weights = centred.T @ np.linalg.solve(gram, y - middle)
    else:
        gram = centred.T @ centred
        gram[np.diag_indices_from(gram)] += ridge * len(x)
        weights = np.linalg.solve(gram, centred.T @ (y - middle))
    return weights, middle - mean @ weights


def fit_model(x: np.ndarray, names: list[str]) -> Model:
    """Fits the bits; a third of the rows, kept aside at first, sets the bits' weights and the sharpness."""
    languages = sorted(set(names))
    number = {n: i for i, n in enumerate(languages)}
    label = np.array([number[n] for n in names])
    code = codewords(len(languages))
    aside = np.arange(len(label)) % 3 == 2
    bit_weights, sharpness = np.ones(code.shape[1]) / max(1, code.shape[1]), 4.0
    if code.shape[1] and aside.any() and len(set(label[~aside])) == len(languages):
        w, b = _least_squares(x[~aside], code[label[~aside]])
        f, truth = x[aside] @ w + b, code[label[aside]]
        good = 1 / (0.02 + np.exp(-np.clip(f * truth, -3, 3)).mean(axis=0))
        bit_weights = good / good.sum()
        trial = Model(languages, code, w, b, bit_weights, 1.0)

        def surprise(s: float) -> float:
            trial.sharpness = s
            return -np.log(np.maximum(trial.probabilities(f)[np.arange(len(f)), label[aside]], 1e-9)).mean()

        sharpness = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=surprise)
    weights, bias = _least_squares(x, code[label]) if code.shape[1] else (np.zeros((x.shape[1], 0)), np.zeros(0))
    return Model(languages, code, weights, bias, bit_weights, sharpness)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def chosen_documents(usable: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> list[tuple[str, int]]:
    """(lang, doc_id) of the documents that a model is fitted on: of each language those with the least hash of doc_id.

    An id counts once for its language however many rows have it, and no language can crowd out another. The list
    has ``total`` entries at most: the total // 2 languages with most rows (ties by name) take part, with two documents each at least.
    """
    spark = usable.sparkSession
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, total // 2))
    sizes = {r["lang"]: r["count"] for r in counts.collect()}
    if not sizes:
        return []
    each = max(2, min(sample, total // len(sizes)))
    keyed = usable.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    # About twice the sample passes a bound on the hash, so that ranking meets few rows of a language however many there
    # are; where repeated ids leave too few, the bound is loosened.
    loose = 1
    while True:
        ends = {lang: min(1.0, loose * (2 * each + 64) / n) for lang, n in sizes.items()}
        bounds = spark.createDataFrame([(lang, min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))) for lang, share in ends.items()], "lang string, most long")
        ids = keyed.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("most")).select("lang", "doc_id", "h").distinct()  # total // 2 rows at most
        ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= each)
        found = [(r["lang"], r["doc_id"]) for r in ranked.collect()]
        have = Counter(lang for lang, _ in found)
        if all(have[lang] >= min(each, n) or ends[lang] == 1 for lang, n in sizes.items()):
            return found
        loose *= 16


def train(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """Fits a model on a bounded number of labelled documents outside the held-out part; None if there is no labelled one.

    Of several rows with one id and language the least text counts. The fit itself runs in one task on the executors,
    on ``total`` rows at most, so that the driver holds the ids and the model only.
    """
    usable = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    chosen = chosen_documents(usable, sample, total)
    if not chosen:
        return None
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, doc_id long"))
    texts = usable.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, ["lang", "doc_id"])
    texts = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def features(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                for at in range(0, part.num_rows, _ROWS):
                    some = part.slice(at, _ROWS)
                    x = ngram_shares(*flat(some.column(2))).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "doc_id", "x"])

    def fit(batches):
        rows = [r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        if rows:
            rows.sort(key=lambda r: (spread(r[1]), r[0]))
            x = np.array([np.frombuffer(r[2], dtype=np.float32) for r in rows], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_model(x, [r[0] for r in rows]))], pa.binary())], names=["model"])

    rows = arrow(texts, features, "lang string, doc_id long, x binary").repartition(1)
    return pickle.loads(arrow(rows, fit, "model binary").first()["model"])


def spread(i: int) -> int:
    """A number by which neighbouring ids are far apart: the order of the rows that are kept aside."""
    return (i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text, ...) -> the columns of docs, and lang_pred string, score double, ambiguous boolean in place of any such columns.

    Whole texts. A text that is null or has no letter, and every text if there is no model, is ``und`` with score 0
    and not ambiguous. Repeated rows get equal results, and lang, source and doc_id play no part. An empty table gives
    an empty one; other columns may have any name.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                for at in range(0, part.num_rows, _ROWS):
                    few = part.slice(at, _ROWS)
                    texts = few.column(few.schema.get_field_index("text"))
                    known = np.array([has_letter(t) for t in texts.to_pylist()], dtype=bool) & (model is not None)
                    names, score, close = [UNKNOWN] * len(known), np.zeros(len(known)), np.zeros(len(known), dtype=bool)
                    if model is not None and known.any():
                        p = model.probabilities(model.outputs(ngram_shares(*flat(texts))))
                        best, ranked = p.argmax(axis=1), np.sort(p, axis=1)
                        score = np.where(known, ranked[:, -1], 0.0)
                        if p.shape[1] > 1:
                            close = known & (ranked[:, -1] - ranked[:, -2] < GAP)
                        names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*few.columns, pa.array(names, pa.string()), pa.array(score), pa.array(close)], names=[*columns, "lang_pred", "score", "ambiguous"])

    return arrow(docs, run, StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields]))
