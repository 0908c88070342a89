"""Filter interaction audit: what each of several document filters removes, alone, after others, and in every order.

A document becomes a bit mask of the filters that it fails. Whether its text stands under a smaller id is settled by a
fingerprint-routed RDD: texts go to partitions by xxhash and arrive there in the order of (hash, id), so that the first of
a chain of equal texts has the least id and all later ones are emitted as copies. A map task first compares the texts it
holds itself and sends one of each, whole, as hashes may collide. Counts by mask are then merged as vectors, and all orders
are read off them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..runtime import ship
from .common import checkpoint, partitions

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
_UPPER, _ODD = bytes(range(65, 91)), re.compile(rb"[#$%&*|]")
#: Bytes of text that a map task holds back to find copies among them, and that a partition of the routed texts gets, about.
HELD, ROUTED = 32 << 20, 64 << 20
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes, n_chars: int) -> int:
    """The mask of the filters A to D that a text fails; bytes.split parts words at exactly the ASCII white space."""
    words = text.split()
    few = len(words) < MIN_WORDS
    same = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    upper = 100 * (len(text) - len(text.translate(None, _UPPER))) > MAX_UPPER * n_chars
    return few | same << 1 | upper << 2 | (_ODD.search(text) is not None) << 3


class Chains:
    """Texts by fingerprint: a chain of [text, least id, mask, rows by part] for each hash, several where hashes collide."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, text: bytes, doc_id: int, mask: int, part: str, n: int = 1) -> Iterator[tuple[int, str, int, int]]:
        """Takes n rows in; yields (id, part, mask, n) for those found to have a copy with a smaller id."""
        chain = self.chains.setdefault(key, [])
        entry = next((x for x in chain if x[0] == text), None)
        if entry is None:
            chain.append([text, doc_id, mask, {part: n}])
            self.size += len(text) + 200
        elif doc_id > entry[1]:
            yield doc_id, part, mask | COPY, n
        elif doc_id == entry[1]:
            entry[3][part] = entry[3].get(part, 0) + n
        else:
            yield from ((entry[1], p, mask | COPY, k) for p, k in entry[3].items())
            entry[1], entry[3] = doc_id, {part: n}

    def drain(self) -> Iterator[tuple[int, list]]:
        yield from ((key, entry) for key, chain in self.chains.items() for entry in chain)
        self.chains, self.size = {}, 0


def _route(rows: Iterator[Row]) -> Iterator[tuple[tuple[int, int], tuple]]:
    """((hash, id), (text, mask, rows by part)) for the least id of each text held, and ((any, id), (None, mask, rows by part)) for what is settled."""
    held, turn = Chains(), 0
    for doc_id, raw, key, part, n_chars in rows:
        text = bytes(raw)
        mask = failures(text, n_chars)
        known = [(None, part, mask, 1)] if doc_id is None else held.add(key, text, doc_id, mask, part)
        for i, p, m, n in known:
            turn += 1
            yield (turn, i or 0), (None, i, m, {p: n})
        if held.size > HELD:
            for k, (t, i, m, parts) in held.drain():
                yield (k, i), (t, i, m, parts)
    for k, (t, i, m, parts) in held.drain():
        yield (k, i), (t, i, m, parts)


def _settle(rows: Iterator[tuple]) -> Iterator[tuple[int | None, str, int, int]]:
    """(id, part, mask, n) in which E is decided; rows come by (hash, id), so only one hash's chain is held."""
    held, at = Chains(), None
    for (key, _), (text, doc_id, mask, parts) in rows:
        if text is None:
            yield from ((doc_id, p, mask, n) for p, n in parts.items())
            continue
        if key != at:
            held, at = Chains(), key
        before = next((x for x in held.chains.get(key, ()) if x[0] == text), None)
        if before is None:
            list(held.add(key, text, doc_id, mask, ""))
            copy = 0
        else:
            copy = COPY if doc_id > before[1] else 0
        yield from ((doc_id, p, mask | copy, n) for p, n in parts.items())


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id long, part string, mask int, n long): docs (doc_id, text, source, ...) by the filters that they fail, bit 0 for A.

    A null text is empty, a null source the empty string. Rows that share an id and a text are no copies of each other, and
    come with their number n. A row with a null id fails E never and makes no other fail it. An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.encode(text, "utf-8"), F.xxhash64(text), F.coalesce(F.col("source").cast("string"), F.lit("")), F.length(text))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    count = max(partitions(spark), -(-size // ROUTED))
    routed = rows.rdd.mapPartitions(_route).repartitionAndSortWithinPartitions(count, lambda key: key[0] % count)
    return spark.createDataFrame(routed.mapPartitions(_settle), "doc_id long, part string, mask int, n long")


def _orders() -> Iterator[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it)."""
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order):
            yield "".join(FILTERS[i] for i in order), step + 1, 1 << k, before
            before |= 1 << k


def _report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part; counts (3, masks): all documents, those of quality, those toxic."""
    mask = np.arange(MASKS)
    rows, total = [], dict.fromkeys((1 << k for k in range(len(FILTERS))), 0)
    for order, step, bit, before in _orders():
        fails, earlier = (mask & bit) > 0, (mask & before) > 0
        here = fails & ~earlier
        removed, good, toxic = (int(x[here].sum()) for x in counts)
        kept, redundant, only = (int(counts[0][x].sum()) for x in (~earlier & ~fails, fails & earlier, mask == bit))
        total[bit] += removed
        rows.append((bit, (part, order, step, kept, removed, redundant, only, good, toxic)))
    yield from ((*row, total[bit]) for bit, row in rows)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of filters A to E in all 120 orders: a row for each part, order and step; see RESULT.

    docs (doc_id, text, source, ...), labels (doc_id, quality, toxic, ...): a document counts as good or toxic if any of
    its labels says 1; null labels and null ids say nothing. Other columns may have any name. Without documents there is no row.
    """
    spark = docs.sparkSession
    seen = checkpoint(masks(docs))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    marks = checkpoint(marks.where("quality + toxic > 0"))  # written, so that the planner can split a hot id of the other side
    rows = seen.join(marks, seen["doc_id"] == marks["_id"], "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(counts: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        counts[0, mask] += n
        counts[1, mask] += n * good
        counts[2, mask] += n * toxic
        return counts

    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add(np.zeros((3, MASKS), np.int64), row), add, lambda a, b: a + b, partitions(spark))
    return spark.createDataFrame(vectors.flatMap(lambda x: _report(*x)), RESULT)
