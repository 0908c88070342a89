"""Collocations: phrases of two and three words that stand together more often than their parts suggest.

Merged count-min sketches come first: tasks send the cells of their n-grams, delta-coded, to the owners of blocks of
cells, which add them up. A cell counts too much but never too little, so the second pass, which counts exactly, needs only
n-grams whose cells all reach the least count, and nothing frequent is lost. What the executors get of the sketch is one
bit a cell. The number of cells follows the text up to CELLS; beyond, more rare n-grams pass through to the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, bounds, checkpoint, cut, flat, grams, mix, partitions, span_hashes, tidy

LEAST, TOP, SUBSUMED = 10, 2000, 50
#: The most cells in a row of the sketch, and rows: 128 MB of bits at most. Text bytes a cell, cells that one task adds up at a time.
CELLS, ROWS, BYTES, BLOCK = 1 << 29, 2, 32, 1 << 20
#: Bytes of text that are counted at once; cells that a task sends together (the more, the smaller the gaps between them), and counts of phrases that it holds.
PIECE, SENT, KEPT = 2 << 20, 4 << 20, 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = np.zeros(256, dtype=bool)
_PART[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE = _PART.copy()
_SPACE[[0x20, 0x09]] = True


class Grams:
    """The n-grams of a batch (text, lang): hashes by length, and which start inside one piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        raw, off = flat(batch.column(0))
        self.data = _LOWER[raw]
        self.starts, self.ends, first = bounds(self.data, off, _SPACE)
        lang = batch.column(1).fill_null("und").dictionary_encode()
        self.langs, codes = lang.dictionary, lang.indices.to_numpy(zero_copy_only=False)
        self.lang = np.repeat(codes, np.diff(first)).astype(np.int64)
        words = span_hashes(self.data, self.starts, self.ends)
        seeds = span_hashes(*_spans(self.langs), seed=2)
        piece = np.cumsum(_PART[self.data], dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(batch)), np.diff(first))
        together = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.whole = [np.ones(len(words), bool), together, together[1:] & together[:-1]]
        self.hashes = [mix((grams(words, n) if n > 1 else words) + seeds[self.lang[: max(0, len(words) - n + 1)]] * np.uint64(2 * n + 1)) for n in (1, 2, 3)]

    def words(self) -> pa.DictionaryArray:
        """The words themselves, coded by equality."""
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        kept = self.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        off = np.zeros(len(self.starts) + 1, dtype=np.int32)
        np.cumsum(self.ends - self.starts, out=off[1:])
        return pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(off.tobytes()), pa.py_buffer(kept.tobytes())).dictionary_encode()


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = flat(texts)
    return data, off[:-1], off[1:]


def _places(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    return [((hashes >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.int64) for row in range(ROWS)]


def cells_for(n_bytes: int) -> int:
    return 1 << min((CELLS - 1).bit_length(), max((BLOCK - 1).bit_length(), int(n_bytes // BYTES).bit_length()))


def _coded(row: int, at: np.ndarray, cells: int) -> pa.RecordBatch:
    """The cells of a row of the sketch as (line, block, gaps, counts, n, wide), a record for each block."""
    at.sort()
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count, at = np.minimum(np.diff(new, append=len(at)), 255).astype(np.uint8), at[new].astype(np.int64)
    edge = np.searchsorted(at, np.arange(0, cells + 1, BLOCK))
    out = []
    for k in np.flatnonzero(np.diff(edge)).tolist():
        gap = np.diff(at[edge[k] : edge[k + 1]] - k * BLOCK, prepend=0)
        wide = int(gap.max() >= 256)
        out.append((row, k, pa.compress(gap.astype(np.uint32 if wide else np.uint8).tobytes(), "zstd", asbytes=True), pa.compress(count[edge[k] : edge[k + 1]].tobytes(), "zstd", asbytes=True), len(gap), wide))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()))], names=["line", "block", "gaps", "counts", "n", "wide"])


def _cells(cells: int):
    """Batches (text, lang) -> (line, block, gaps, counts, n, wide): the cells that the n-grams add to, by row and block of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for batch in batches:
            for part in cut(batch, "text", PIECE):
                g = Grams(part)
                for hashes, whole in zip(g.hashes, g.whole, strict=True):
                    for at, places in zip(held, _places(hashes[whole], cells), strict=True):
                        at.append(places.astype(np.uint32))
                if sum(map(len, held[0])) >= SENT:
                    for row, at in enumerate(held):
                        yield _coded(row, np.concatenate(at), cells)
                        at.clear()
            tidy()
        for row, at in enumerate(held):
            if sum(map(len, at)):
                yield _coded(row, np.concatenate(at), cells)

    return run


def _added(rows: Iterator[tuple]) -> Iterator[tuple[int, int, bytes]]:
    """Adds up the cells of each block (saturated at 255) and keeps a bit a cell: whether it reaches LEAST."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for key, (gaps, counts, n, wide) in rows:
        total = sums.setdefault(key, np.zeros(BLOCK, dtype=np.uint8))
        at = np.cumsum(np.frombuffer(pa.decompress(gaps, n * (4 if wide else 1), "zstd", asbytes=True), dtype=np.uint32 if wide else np.uint8), dtype=np.int64)
        more = np.frombuffer(pa.decompress(counts, n, "zstd", asbytes=True), dtype=np.uint8)
        total[at] += np.minimum(more, 255 - total[at])
    for (row, block), total in sums.items():
        yield row, block, np.packbits(total >= LEAST, bitorder="little").tobytes()


def sketch(texts: DataFrame, cells: int) -> np.ndarray:
    """(ROWS, cells / 8) bytes: which cells of the merged sketch of texts (text, lang) reach LEAST. cells / 4 bytes come to the driver."""
    count = partitions(texts.sparkSession)
    sent = arrow(texts, _cells(cells), "line int, block int, gaps binary, counts binary, n int, wide int")
    owner = lambda key: key[1] * ROWS + key[0]
    added = sent.rdd.map(lambda r: ((r[0], r[1]), tuple(r[2:]))).partitionBy(count, owner).mapPartitions(_added)
    bits = np.zeros((ROWS, cells // 8), dtype=np.uint8)
    for row, block, part in added.collect():
        bits[row, block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(part, dtype=np.uint8)
    return bits


def _dense(keys: np.ndarray) -> np.ndarray:
    return pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=5)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])


def _share_of(table: pa.Table, shares: int) -> np.ndarray:
    """The share that each row of (lang, phrase, f) belongs to, by hashes of both."""
    lang, phrase = (span_hashes(*_spans(table[c].combine_chunks()), seed=seed) for c, seed in (("lang", 3), ("phrase", 4)))
    return ((lang * np.uint64(3) + phrase) % np.uint64(shares)).astype(np.int32)


def _counted(bits, cells: int, shares: int):
    """Batches (text, lang) -> (share, lang, phrases, counts, sizes): exact counts of n-grams whose cells all reach LEAST, and of all words under an empty phrase.

    A row has the sorted phrases of a share and language, line by line, and their counts, both compressed: neighbours share their
    beginnings, so it is a fraction of what rows of their own would be. A task adds up all that it reads before it sends, KEPT phrases at a
    time at most.
    """

    def frequent(hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for row, at in zip(bits.value, _places(hashes, cells), strict=True):
            out &= (row[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def counted(part: pa.RecordBatch) -> Iterator[pa.Table]:
        g = Grams(part)
        coded = g.words()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = len(coded.dictionary)
        ok = [w & frequent(h) for h, w in zip(g.hashes, g.whole, strict=True)]
        ok[1] &= ok[0][1:] & ok[0][:-1]  # what is frequent has frequent parts
        ok[2] &= ok[1][1:] & ok[1][:-1]
        total = np.bincount(g.lang, minlength=len(g.langs))
        yield pa.table([g.langs, pa.array([""] * len(g.langs), pa.string()), pa.array(total, pa.int64())], names=["lang", "phrase", "f"])
        code = g.lang
        for n in range(3):
            at = np.flatnonzero(ok[n])
            dense = _dense(code[at] * size + word[at + n])
            f = np.bincount(dense)
            first = np.zeros(len(f), dtype=np.int64)
            first[dense[::-1]] = at[::-1]
            text = [coded.dictionary.take(pa.array(word[first + k])) for k in range(n + 1)]
            yield pa.table([g.langs.take(pa.array(g.lang[first])), text[0] if n == 0 else pc.binary_join_element_wise(*text, " "), pa.array(f, pa.int64())], names=["lang", "phrase", "f"])
            code = np.zeros(len(word), dtype=np.int64)
            code[at] = dense

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.append_column("share", pa.array(_share_of(table, shares)))
        table = table.take(pc.sort_indices(table, [("share", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])).combine_chunks()
        share, lang = table["share"].to_numpy(), table["lang"].combine_chunks().dictionary_encode()
        code = lang.indices.to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.append(True, (share[1:] != share[:-1]) | (code[1:] != code[:-1])))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(edge, len(share)).astype(np.int32)), table["phrase"].combine_chunks()), "\n").cast(pa.binary())
        f = table["f"].to_numpy()
        for k, (a, b) in enumerate(zip(edge, [*edge[1:], len(share)], strict=True)):
            text = lines[k].as_buffer()
            yield pa.RecordBatch.from_arrays([pa.array([share[a]], pa.int32()), pa.array([lang.dictionary[code[a]].as_py()], pa.string()), pa.array([_zstd().compress(text, asbytes=True)], pa.binary()), pa.array([_zstd().compress(f[a:b].tobytes(), asbytes=True)], pa.binary()), pa.array([[len(text), b - a]], pa.list_(pa.int64()))], names=["share", "lang", "phrases", "counts", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in cut(batch, "text", PIECE):
                held += counted(part)
                if sum(map(len, held)) > KEPT:
                    held = [_summed(held)]
                    if len(held[0]) > KEPT * 3 // 4:
                        yield from sent(held[0])
                        held = []
            tidy()
        if held:
            yield from sent(_summed(held))

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_counted`` in order of share -> (lang, phrase, f): the sums that reach LEAST, and those of all words with a null phrase."""

    def done(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            table = _summed(held)
            words = pc.equal(table["phrase"], "")
            table = table.set_column(1, "phrase", pc.if_else(words, pa.scalar(None, pa.string()), table["phrase"])).filter(pc.or_(words, pc.greater_equal(table["f"], LEAST)))
            yield from table.combine_chunks().to_batches()

    now, held = None, []
    for batch in batches:
        for share, lang, text, counts, (size, n) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
            if share != now:
                yield from done(held)
                now, held = share, []
            lines = pa.array([_zstd().decompress(text.as_buffer(), size, asbytes=True)], pa.binary()).cast(pa.string())
            phrases = pc.split_pattern(lines, "\n").flatten()
            f = pa.array(np.frombuffer(_zstd().decompress(counts.as_buffer(), 8 * n, asbytes=True), np.int64))
            held.append(pa.table([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int64))), phrases, f], names=["lang", "phrase", "f"]))
            if len(held) > 64 and sum(map(len, held)) > KEPT:
                held = [_summed(held)]
    yield from done(held)


def phrase_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase string, f long): every phrase of one to three words that stands LEAST times in the texts of a language, words joined by a space, with its exact count; and the number of all words under a null phrase."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    cells = cells_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits, shares = spark.sparkContext.broadcast(sketch(texts, cells)), 2 * partitions(spark)
    parts = arrow(texts, _counted(bits, cells, shares), "share int, lang string, phrases binary, counts binary, sizes array<long>").repartition(partitions(spark), "share").sortWithinPartitions("share")
    counts = checkpoint(arrow(parts, _totals, "lang string, phrase string, f long"))
    bits.destroy()
    return counts


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang string, rank long, phrase string, a, l, r, n, score long): the best phrases of each language, docs (text, lang, ...).

    a, l, r count the phrase and its two parts at the cut that scores least (ties: the first), n all words of the language; score is
    floor(1000000 a a / (l r)), in decimals of 38 digits: exact for counts below 10**15. A phrase of two words goes if a frequent one of three
    holds it and has half its count. Order: score, a (both descending), phrase in byte order. A null language is ``und``, a null
    text empty; repeated rows count as often as they come, ids are not looked at; other columns may have any name. Without frequent phrases there is no row.
    """
    counts = phrase_counts(docs)
    single = counts.where("phrase is not null")
    words = F.split("phrase", " ")
    phrases = single.where(F.contains("phrase", F.lit(" "))).select("lang", F.col("f").alias("a"), words.alias("w"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.cast("byte").alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("right")))
    parts = phrases.select("lang", "a", F.explode(cuts).alias("c")).select("lang", "a", "c.*")  # the phrase itself is left and right
    left = single.select(F.col("lang").alias("lang_l"), F.col("phrase").alias("left_l"), F.col("f").alias("l"))
    right = single.select(F.col("lang").alias("lang_r"), F.col("phrase").alias("right_r"), F.col("f").alias("r"))
    parts = parts.join(left, (F.col("lang") == F.col("lang_l")) & (F.col("left") == F.col("left_l"))).select("lang", "a", "k", "left", "right", "l")
    parts = parts.join(right, (F.col("lang") == F.col("lang_r")) & (F.col("right") == F.col("right_r")))
    big = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a")), big("l") * big("r"))
    scored = parts.select("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "a", F.struct(score.alias("score"), "k", "l", "r").alias("s")).groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))
    inner = phrases.where(F.size("w") == 3).select(F.col("lang").alias("lang_i"), "a", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("inside"))
    inner = inner.groupBy("lang_i", "inside").agg(F.max("a").alias("longer"))
    held = scored.join(inner, (F.col("lang") == F.col("lang_i")) & (F.col("phrase") == F.col("inside")) & (100 * F.col("longer") >= SUBSUMED * F.col("a")), "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = held.select("lang", "phrase", "a", "s.*").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("phrase is null").select(F.col("lang").alias("lang_n"), F.col("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("lang_n")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
