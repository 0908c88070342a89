"""Line dedup by winnowing over line hashes.

A document's lines (split at \\n, blank ones aside) are hashed. From each window of ``run`` consecutive lines
winnowing selects the line with the least hash (the leftmost of equals), so two equal windows always select the
same line: these fingerprints guarantee that no repeated run of ``run`` lines is missed. Each fingerprint travels with
its position and with hashes of the lines to both sides of it, as far as its windows reach. Positions of equal
fingerprints are joined where those sides agree: each later position with the first one, so that a line that stands in
very many documents makes as many matches as it has positions and no pairs among them. Matches of one pair of
documents on one diagonal are then chained to both sides into the maximal run that the two share, and the later one
of the two runs is deleted.

With ``words`` (the pipeline's setting; op5 is bound to its SQL, which knows runs of lines only) shorter runs count by
their content: a window of fewer lines that holds ``words`` words, and a whole document of fewer lines, which is held
against whole documents only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow, bounds, checkpoint, cut, flat, fresh, grams, merged, quoted, signed, span_hashes, window_minima

RUN = 3
#: Words by which a run of fewer than RUN lines counts in the pipeline.
CONTENT = 50
#: A window's number in ``starts``: its first line times SPAN, and its length in lines.
SPAN = 16
_TRIM = b" \t\r\x0b\x0c"


def _lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those that are not blank."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(_TRIM)]


def _windows(batch: pa.RecordBatch, run: int, words: int | None) -> pa.RecordBatch:
    """A row for each selected line: its fingerprint, and the windows that selected it with two hashes each. Shorter windows that count by their content have a row each."""
    stripped, counts = [], []
    for text in batch.column(2).cast(pa.binary()).to_pylist():
        full = [y for x in (text or b"").split(b"\n") if (y := x.strip(_TRIM))]
        stripped += full
        counts.append(len(full))
    data, off = flat(pa.array(stripped, pa.binary()))
    hashes = span_hashes(data, off[:-1], off[1:])
    at = window_minima(hashes, run)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    inside = np.flatnonzero(row[: len(at)] == row[len(hashes) - len(at) :]) if len(at) else np.zeros(0, np.int64)
    at, k1, k2 = at[inside], grams(hashes, run, 1)[inside], grams(hashes, run, 2)[inside]
    new = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    fps, rows = [hashes[at[heads]]], [row[at[heads]]]
    starts, keys1, keys2, lists = [(inside - first[row[inside]]) * SPAN + run], [k1], [k2], [heads]
    for length in range(1, run) if words is not None and len(hashes) else ():
        total = np.concatenate(([0], np.cumsum(np.diff(bounds(data, off)[2]))))
        i = np.arange(max(0, len(hashes) - length + 1))
        i = i[row[i] == row[i + length - 1]]
        whole = np.asarray(counts)[row[i]] == length
        j1, j2 = grams(hashes, length, 1), grams(hashes, length, 2)
        for some, mark in ((i[total[i + length] - total[i] >= words], 2 * length), (i[whole & (total[i + length] - total[i] < words)], 2 * length + 1)):
            salt = np.uint64(mark * 0x9E3779B97F4A7C15 % (1 << 64))
            lists.append(sum(map(len, starts)) + np.arange(len(some)))
            starts.append((some - first[row[some]]) * SPAN + length)
            keys1.append(j1[some] + salt)
            keys2.append(j2[some] + salt)
            fps.append(j1[some] + salt)
            rows.append(row[some])
    rows = pa.array(np.concatenate(rows))
    structs = pa.StructArray.from_arrays([pa.array(np.concatenate(starts).astype(np.int32)), pa.array(signed(np.concatenate(keys1))), pa.array(signed(np.concatenate(keys2)))], names=["s", "k1", "k2"])
    ends = np.concatenate((*lists, [len(structs)])).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(np.concatenate(fps))), batch.column(0).take(rows), batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(ends), structs)],
        names=["fp", "doc_id", "_row_key", "wins"],
    )


def matches(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, _row_key, seeds array<struct<s, source_id, source_key, source_s>>): the windows of docs (with _row_key) that stand earlier, and where first.

    s numbers a window by its first full line and its length (see SPAN).
    """

    def scan(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                yield _windows(part, run, words)

    schema = "fp long, doc_id long, _row_key long, wins array<struct<s:int,k1:long,k2:long>>"
    found = arrow(docs.select("doc_id", "_row_key", "text"), scan, schema)
    # Both sides of these joins are dealt out anew, so that the adaptive planner can split a frequent line or passage.
    often = checkpoint(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    near = checkpoint(found.join(merged(often), "fp").select("doc_id", "_row_key", F.explode("wins").alias("w")).select("doc_id", "_row_key", "w.*"))
    place = F.struct("doc_id", "_row_key", "s")
    first = checkpoint(near.groupBy("k1", "k2").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "least"))
    later = near.join(merged(first), ["k1", "k2"]).where(place > F.col("least"))
    seed = F.struct("s", F.col("least.doc_id").alias("source_id"), F.col("least._row_key").alias("source_key"), F.col("least.s").alias("source_s"))
    return later.groupBy("doc_id", "_row_key").agg(F.collect_set(seed).alias("seeds"))


def chain(seeds: list) -> list[tuple[int, int, int, int]]:
    """Seeds (s, source_id, source_key, source_s) of one document -> its maximal runs (first full line, number of lines, source_id, first full line there), in order.

    Seeds of one source whose lines keep one distance are chained while they overlap or touch.
    """
    spans = sorted((x[1], x[2], x[3] // SPAN - x[0] // SPAN, x[0] // SPAN, x[0] % SPAN) for x in seeds)
    runs: list[list[int]] = []
    for source, key, shift, at, length in spans:
        if runs and runs[-1][:3] == [source, key, shift] and at <= runs[-1][3] + runs[-1][4]:
            runs[-1][4] = max(runs[-1][4], at + length - runs[-1][3])
        else:
            runs.append([source, key, shift, at, length])
    return sorted((at, length, source, at + shift) for source, _, shift, at, length in runs)


def _removed(full: int, runs: list[tuple[int, int, int, int]]) -> np.ndarray:
    covered = np.zeros(full + 1, dtype=np.int64)
    for at, length, *_ in runs:
        covered[at] += 1
        covered[at + length] -= 1
    return np.flatnonzero(np.cumsum(covered[:-1]) > 0)


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = None, with_runs: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with the repeated runs taken out of text, and the columns n_lines and n_removed after the others.

    A line is removed if a run of ``run`` or more consecutive full lines covers it that also stands, line for line (white
    space at line ends aside), at an earlier (doc_id, line). With ``words`` so do shorter runs of that many words,
    and whole documents of fewer than ``run`` full lines that an earlier document equals. Runs are judged on the input. Blank lines are never
    compared: they stay, but those inside a removed run go. Texts without a repeated run are unchanged; a null text
    stays null with 0 lines. Rows with a null doc_id are neither compared nor changed. Rows that share a doc_id are
    ordered by a hash of their text; a fully repeated row counts as the same place and keeps its lines. An empty table
    gives an empty one. Columns of docs named n_lines, n_removed or runs are replaced; others may have any name.
    with_runs: also the removed runs, as array<struct<first, lines, source_id, source_first>> in full lines from 0.
    """
    extra = "n_lines long, n_removed long" + (", runs array<struct<first:int,lines:int,source_id:long,source_first:int>>" if with_runs else "")
    docs = docs.drop(*[c for c in ("n_lines", "n_removed", *["runs"] * with_runs) if c in docs.columns])
    columns = docs.columns
    key, hit_id, hit_key, hits_of = fresh(docs, "row_key", "hit_id", "hit_key", "seeds")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    some = keyed.where("doc_id is not null")
    hits = matches(some.select("doc_id", F.col(key).alias("_row_key"), "text"), run, words).toDF(hit_id, hit_key, hits_of)
    joined = some.join(hits, (some["doc_id"] == hits[hit_id]) & (some[key] == hits[hit_key]), "left").select(*map(quoted, columns), hits_of)
    joined = joined.unionByName(docs.where("doc_id is null").select(*map(quoted, columns), F.lit(None).cast(hits.schema[hits_of].dataType).alias(hits_of)))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(extra).fields])

    def apply(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                place = part.schema.get_field_index("text")
                texts, seeds = part.column(place).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                n_lines, n_removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                runs: list[list[tuple]] = [[] for _ in texts]
                for i, (text, hit) in enumerate(zip(texts, seeds, strict=True)):
                    if text is None:
                        continue
                    n_lines[i] = text.count("\n") + 1
                    if hit:
                        lines, full = _lines(text.encode())
                        runs[i] = chain([tuple(x.values()) for x in hit])
                        gone = _removed(len(full), runs[i])
                        drop = {full[k] for k in gone.tolist()}
                        for a, b in zip(gone[:-1].tolist(), gone[1:].tolist(), strict=True):
                            if b == a + 1:
                                drop.update(range(full[a], full[b]))
                        texts[i] = b"\n".join(x for k, x in enumerate(lines) if k not in drop).decode()
                        n_removed[i] = len(drop)
                arrays = [*part.columns[:-1], pa.array(n_lines), pa.array(n_removed)]
                arrays[place] = pa.array(texts, part.column(place).type)
                names = [*columns, "n_lines", "n_removed"]
                if with_runs:
                    kind = pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32()), ("source_id", pa.int64()), ("source_first", pa.int32())]))
                    arrays.append(pa.array([[dict(zip(("first", "lines", "source_id", "source_first"), r, strict=True)) for r in x] for x in runs], kind))
                    names.append("runs")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow(joined, apply, schema)
