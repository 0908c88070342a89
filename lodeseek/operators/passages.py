"""Text in, documents out: whole texts are cut into windows of tokens, encoded window by window, and searched.

A window is a row with a list of tokens, and what the encoder makes of it goes straight into packed blocks: at no time is
there a row for each token. The windows of a document stay together in the task that cut it, so nothing is shuffled.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B
from .encode import Encoder, HashEncoder
from .lazy import Lazy, loaded
from .quantize import query_blocks
from .scoring import top_k

#: Vectors of a document that stay in one block; a longer document is cut into parts, whose scores are combined by document.
WHOLE = 1 << 16
MARKER = ("[D]",)
#: Of the tokens of a passage that is held, the most by which their best scores together stay below their number.
LACK = 0.05
#: Keys of blocks of whole documents, and of parts of long ones.
COMPLETE, PART = 0, 1


def _words(text: str) -> list[str]:
    """White-space words, as functions.text.words: bytes are split at ASCII white space alone."""
    return [w.decode() for w in text.encode().split()]


def encode_windows(docs: DataFrame, encoder: Encoder | Lazy | None = None, size: int = 500, overlap: int = 100, tokenizer=None, marker: tuple[str, ...] = MARKER, single: bool = False) -> DataFrame:
    """(doc_id, text) -> blocks (key, ids, subs, data) of all vectors of whole texts, sub being the number of the window.

    Every window is encoded by itself, led by the marker's tokens: ``size`` tokens with them, one every ``size`` - ``overlap``. No
    token is left out, however long the text; a null text is one window of the marker alone, and rows without an id are left
    out. Of a pointwise encoder a document's equal tokens are kept once, as more of them change no score. single: vectors are kept
    in single precision.
    """
    model_of, kind, lead = encoder or HashEncoder(), np.float32 if single else np.float64, list(marker)
    step, width = size - overlap, size - len(lead)
    if step <= 0 or width <= 0:
        raise ValueError("chunks must advance and hold more than their markers")

    def windows(words: list[str]):
        """chunk_windows of one text."""
        for chunk in range(max(0, -(-(len(words) - width) // step)) + 1):
            yield chunk, words[chunk * step : chunk * step + width]

    def packed(key: int, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(v) for *_, v in held]
        ids, subs = (np.repeat(np.array([h[k] for h in held], dtype=np.int64), sizes) for k in (0, 1))
        data = np.concatenate([v for *_, v in held]).astype(kind, copy=False)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, subs, data)]], names=["key", "ids", "subs", "data"])

    def run(batches):
        model, split = loaded(model_of), loaded(tokenizer) if tokenizer else _words
        once, met = getattr(model, "pointwise", False), set()
        block, block_n, doc, doc_n, long = [], 0, [], 0, False

        def ended():
            """Puts the document that has ended into the block, or its last part into one of its own."""
            nonlocal block, block_n
            if long:
                yield packed(PART, doc)
            elif doc:
                block += doc
                block_n += doc_n
                if block_n >= B.ROWS:
                    yield packed(COMPLETE, block)
                    block, block_n = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                for doc_id, chunk, tokens in ((d, *w) for d, t in zip(*[part.column(k).to_pylist() for k in range(2)], strict=True) for w in windows(list(split(t)) if t is not None else [])):
                    tokens = [*lead, *tokens]
                    if chunk == 0:
                        yield from ended()
                        doc, doc_n, long, met = [], 0, False, set()
                    if once:
                        tokens = [t for t in dict.fromkeys(tokens) if t not in met]
                        if len(met) < WHOLE:
                            met.update(tokens)
                    vectors = np.asarray(model.vectors(tokens), dtype=np.float64).reshape(-1, model.dim)
                    if chunk and doc_n + len(vectors) > WHOLE:
                        yield packed(PART, doc)
                        doc, doc_n, long = [], 0, True
                    doc.append((doc_id, chunk, vectors))
                    doc_n += len(vectors)
        yield from ended()
        if block:
            yield packed(COMPLETE, block)

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return B.arrow(kept, run, "key long, ids binary, subs binary, data binary")


def window_scores(packed: DataFrame, queries: DataFrame, k: int | None = None, share: float | None = None) -> DataFrame:
    """(query_id, doc_id, score) of encode_windows: for each query token the best token over all windows of the document, summed.

    k: only rows that may be among a query's k best. share: only documents whose score is at least this share of the number of
    query tokens, the most that unit vectors can reach. Texts that share an id are scored apart, and the best counts.
    """
    n, dim = B.shape(queries, "qvec")
    if dim is None:
        return packed.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    asked = query_blocks(queries, dim)
    if 8 * n * dim <= B.BROADCAST:
        found = B.searched(packed, asked, dim, PART, k, share).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.collect_list("best").alias("all"))
        long, some = B.summed("all"), F.size("all") > 0
        long = F.when(some if share is None else some & (long >= share * F.size(F.get("all", F.lit(0)))), long)
        return found.select("query_id", "doc_id", F.greatest("score", long).alias("score")).where("score is not null")
    kernel = B.Products(dim)
    whole = B.whole_scores(B.Pairs(packed.where(F.col("key") == COMPLETE), asked, 8 * n * dim), kernel, k, share)
    rows = queries.select(F.lit(0).cast("long").alias("key"), F.col("query_id").cast("long").alias("id"), F.shiftleft(F.col("q_tok").cast("long"), 32).alias("sub"), V.doubles("qvec"), F.lit(0.0))
    asked = B.pack(rows.repartition("id").sortWithinPartitions("id", "sub"), dim, B.QUERY_ROWS)
    long = B.combine(B.part_scores(B.every_pair(packed.where(F.col("key") == PART), asked, 8 * n * dim), kernel))
    if share is not None:
        sizes = queries.groupBy("query_id").agg(F.count("*").alias("_n")).withColumnRenamed("query_id", "_q")
        long = long.join(sizes, F.col("query_id") == F.col("_q")).where(F.col("score") >= share * F.col("_n")).drop("_q", "_n")
    return whole.unionByName(long).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def search_windows(packed: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query."""
    return top_k(window_scores(packed, queries, k), k)


def holding(packed: DataFrame, queries: DataFrame, share: float = 0.9999) -> DataFrame:
    """(query_id, doc_id): all documents that have, for each query token, nearly the same one: where a passage that the query repeats may stand.

    However many tokens a query has, one that is missing is not made up for by the others: LACK is the most that all of them may lack.
    """
    most = queries.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
    share = max(share, 1 - LACK / most)
    return window_scores(packed, queries, share=share).select("query_id", "doc_id")


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents (doc_id, text) that contain the passage (query_id, passage) as it stands.

    All passages are sought at once: an automaton that each worker makes once reads a text from end to end, however many they are.
    Passages of more bytes than may go to all tasks are found by their words.
    """
    docs, passages = docs.where("doc_id is not null and text is not null"), passages.where("query_id is not null and passage is not null")
    if (passages.agg(F.sum(F.octet_length("passage"))).first()[0] or 0) > B.BROADCAST // 16:
        return _by_words(docs, passages)
    named: dict[str, list[int]] = {}
    for query, passage in passages.select(F.col("query_id").cast("long"), "passage").collect():
        named.setdefault(passage, []).append(query)
    sent = docs.sparkSession.sparkContext.broadcast(named)

    def run(batches):
        machine, always = ahocorasick.Automaton(), sent.value.get("", [])
        for passage, queries in sent.value.items():
            if passage:
                machine.add_word(passage, queries)
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            found = [(q, doc) for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) for q in {*always, *(q for _, queries in (machine.iter(text) if len(machine) else ()) for q in queries)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["query_id", "doc_id"])

    return B.arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "query_id long, doc_id long").distinct()


def _by_words(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """containing by joins: the words inside a passage are whole words of the document too. A run of five, three or one of them, from the
    second on, is joined by its hash with the documents' runs, and what meets is held against the text. Only passages of one or two
    words meet every text.
    """
    split = lambda c: F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    cut = passages.where("passage is not null").withColumn("_w", split("passage"))
    length = F.when(F.size("_w") >= 7, 5).when(F.size("_w") >= 5, 3).when(F.size("_w") >= 3, 1).otherwise(0)
    cut = cut.withColumn("_l", length)
    keyed = cut.where("_l > 0").select("query_id", "passage", "_l", F.xxhash64(F.slice("_w", F.lit(2), F.col("_l"))).alias("_h"))
    words = docs.where("text is not null").select("doc_id", split("text").alias("_w"))
    out = None
    run = lambda n: lambda i: F.xxhash64(F.slice("_w", i, F.lit(n)))
    for n in (5, 3, 1):
        runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), run(n))
        starts = words.where(F.size("_w") >= n).select("doc_id", F.explode(F.array_distinct(runs)).alias("_h"))
        one = starts.join(keyed.where(F.col("_l") == n).select("query_id", "_h"), "_h").select("query_id", "doc_id")
        out = one if out is None else out.union(one)
    near = out.distinct().join(passages, "query_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = docs.select("doc_id", "text").join(cut.where("_l = 0").select("query_id", "passage"), F.contains("text", "passage")).select("query_id", "doc_id")
    return near.union(short).distinct()
