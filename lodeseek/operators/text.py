"""Corpus preparation: keyword counts, first-seen dedup, chunk windows, stacked tokens, statistics."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from .blocks import arrow
from .lazy import Lazy, loaded


def keyword_scan(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, n_docs, first_id, example): documents that contain each keyword, whatever the case, the smallest id among them and the beginning of its text (null if none).

    All keywords are sought at once: an automaton that each worker makes once reads a text from end to end, however many they are. What leaves a task is a
    row for each keyword that it has met. A keyword that is listed twice comes twice; an empty one is in every text.
    """
    low = [k.lower() for k in keywords]
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.lower("text").alias("low"), T.snippet(F.col("text")).alias("example"))
    sent = docs.sparkSession.sparkContext.broadcast(sorted(set(low)))

    def run(batches):
        words = sent.value
        machine = ahocorasick.Automaton()
        for i, k in enumerate(words):
            if k:
                machine.add_word(k, i)
        if len(machine):
            machine.make_automaton()
        blank = [i for i, k in enumerate(words) if not k]
        count, first, example = np.zeros(len(words), np.int64), np.full(len(words), np.iinfo(np.int64).max), [None] * len(words)
        for batch in batches:
            for doc_id, text, shown in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for i in {i for _, i in machine.iter(text)} | set(blank) if len(machine) else blank:
                    count[i] += 1
                    if doc_id is not None and doc_id < first[i]:
                        first[i], example[i] = doc_id, shown
        met = np.flatnonzero(count)
        some = first[met] < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in met], pa.string()), pa.array(count[met]), pa.array(first[met], mask=~some), pa.array([example[i] for i in met], pa.string())], names=["_k", "n", "id", "example"])

    found = arrow(rows, run, "_k string, n long, id long, example string")
    best = found.groupBy("_k").agg(F.sum("n").alias("n_docs"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "example"))).alias("_b"))
    asked = docs.sparkSession.createDataFrame(list(zip(keywords, low, strict=True)), "keyword string, _w string")
    return asked.join(best, F.col("_w") == F.col("_k"), "left").select("keyword", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.col("_b.id").alias("first_id"), F.col("_b.example").alias("example"))


def dedup_first(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each distinct text. The smallest id is found with map-side combine, so a text that many rows share is no hot key."""
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "text")


def limit_unique(docs: DataFrame, n: int) -> DataFrame:
    return dedup_first(docs).orderBy("doc_id").limit(n)


def n_chunks(length: Column, size: int, overlap: int, markers: int = 1) -> Column:
    step = size - overlap
    if step <= 0 or size <= markers:
        raise ValueError("chunks must advance and hold more than their markers")
    return F.greatest(F.ceil((length - (size - markers)) / F.lit(step)), F.lit(0)).cast("int") + 1


def chunk_windows(docs: DataFrame, size: int = 500, overlap: int = 100, markers: int = 1, max_tokens: int | None = None) -> DataFrame:
    """(doc_id, tokens array) -> (doc_id, chunk_idx int, start, end, tokens): overlapping windows of size - markers tokens, one every size - overlap."""
    tokens = F.col("tokens") if max_tokens is None else F.slice("tokens", 1, max_tokens)
    rows = docs.select("doc_id", tokens.alias("tokens"))
    length = F.size("tokens")
    step, width = size - overlap, size - markers
    starts = F.transform(F.sequence(F.lit(0), n_chunks(length, size, overlap, markers) - 1), lambda i: i * step)
    rows = rows.select("doc_id", "tokens", F.posexplode(starts).alias("chunk_idx", "start"))
    end = F.least(F.col("start") + width, F.size("tokens"))
    return rows.select("doc_id", "chunk_idx", "start", end.alias("end"), F.slice("tokens", F.col("start") + 1, F.greatest(end - F.col("start"), F.lit(0))).alias("tokens"))


def prefix_offsets(rows: DataFrame, order: str, n: str, spans: int = 1024) -> DataFrame:
    """(order long unique, n) -> (order, offset long): the sum of n over all smaller order values.

    In two steps, so that no task sorts the whole table: running sums within spans of the order column, plus the sum of
    the earlier spans. The spans are cut at quantiles of the order column, so they hold about equally many rows however
    the values are spread.
    """
    rows = rows.select(order, F.col(n).cast("long").alias("_n"))
    cuts = rows.agg(F.percentile_approx(order, [k / spans for k in range(1, spans)], 10 * spans)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    spanned = Bucketizer(splits=splits, inputCol="_o", outputCol="_span").transform(rows.withColumn("_o", F.col(order).cast("double"))).drop("_o")
    sums = spanned.groupBy("_span").agg(F.sum("_n").alias("_s"))
    before = sums.select("_span", F.coalesce(F.sum("_s").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spanned.withColumn("_i", inside).join(F.broadcast(before), "_span").select(order, (F.col("_i") + F.col("_b")).alias("offset"))


def stack_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens array) -> (token_id long, doc_id, pos int, token): one row per token, numbered in document order."""
    offsets = prefix_offsets(docs.select("doc_id", F.size("tokens").alias("n")), "doc_id", "n")
    rows = docs.join(offsets, "doc_id").select("doc_id", "offset", F.posexplode("tokens").alias("pos", "token"))
    return rows.select((F.col("offset") + F.col("pos")).alias("token_id"), "doc_id", "pos", "token")


def tokenized(docs: DataFrame, id_column: str = "doc_id", tokenizer: Lazy | Callable[[str], list[str]] | None = None) -> DataFrame:
    """(doc_id, tokens array): white-space words, or what a tokenizer makes of each text (null: none)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col("text"))
    if tokenizer is None:
        return rows.select("doc_id", T.words(F.col("text")).alias("tokens"))

    def run(batches):
        split = loaded(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = [list(split(t)) if t is not None else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "tokens"])

    return arrow(rows, run, StructType([rows.schema["doc_id"], *StructType.fromDDL("tokens array<string>").fields]))


def order_statistic(rows: DataFrame, value: str, shares: list[float], keys: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """The element int(n * p) (from 0) of the sorted values for each share p, by key: (keys..., p, value).

    A sketch first brackets each element within n / accuracy ranks to both sides; only the values inside the bracket are
    then counted and ranked, from the exact number of those below it. So no task sorts all values of a key.
    """
    keys = keys or []
    rows = rows.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    near = 2.0 / accuracy
    wanted = [F.struct(F.lit(float(p)).alias("p"), *[F.percentile_approx("_v", min(1.0, max(0.0, p + d)), accuracy).alias(n) for d, n in ((-near, "lo"), (near, "hi"))]) for p in shares]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.array(*wanted).alias("_b")).select(*keys, "_n", F.inline("_b"))
    bounds = bounds.withColumn("_at", F.least(F.floor(F.col("_n") * F.col("p")), F.col("_n") - 1))
    joined = rows.join(bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))
    below = joined.groupBy(*keys, "p").agg(F.count_if(F.col("_v") < F.col("lo")).alias("_below"))
    inside = joined.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).groupBy(*keys, "p", "_at", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.join(below, [*keys, "p"]).withColumn("_hi", F.col("_below") + upto)
    return ranked.where((F.col("_at") < F.col("_hi")) & (F.col("_at") >= F.col("_hi") - F.col("_c"))).select(*keys, "p", F.col("_v").alias(value))


def median(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys..., median): half the sum of the two middle values, which are the element n // 2 from below and from above."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("_s"), (F.col(value).cast("double") * s).alias("_x")) for s in (1.0, -1.0)]))
    both = rows.select(*keys, sides.alias("_b")).select(*keys, "_b.*")
    middle = order_statistic(both, "_x", [0.5], [*keys, "_s"])
    return middle.groupBy(*keys).agg((F.sum(F.col("_s") * F.col("_x")) / 2).alias("median"))
