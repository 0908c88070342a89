"""Words into sub-words of a given vocabulary, longest match first, in one pass over each word.

The vocabulary's pieces form a trie with failure links: where no longer match goes on, a node knows which pieces are certain by then and where
matching continues, so no character is read twice (Song et al., 2021). Pieces inside a word are led by a mark, ``##``. Each worker
builds the trie once and keeps the pieces of words that it has seen.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

UNKNOWN, LEAD = "[UNK]", "##"
#: Characters of a word, at most: longer ones are unknown. Words that a worker remembers.
LONGEST, KNOWN = 100, 200_000
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


class _Node:
    __slots__ = ("after", "fail", "piece", "pops")

    def __init__(self) -> None:
        self.after: dict[str, _Node] = {}
        self.piece: str | None = None
        self.fail: _Node | None = None
        self.pops: list[str] = []


class Subwords:
    """A tokenizer of whole texts: calling it with a text gives its pieces, UNKNOWN for a word that the vocabulary cannot spell."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = sorted(set(vocabulary) - {"", LEAD})
        self.root: _Node | None = None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "root": None}

    def _build(self) -> None:
        self.root, self.inner, self.known = _Node(), _Node(), {}
        for piece in self.vocabulary:
            inside = piece.startswith(LEAD)
            node = self.inner if inside else self.root
            for c in piece[len(LEAD) :] if inside else piece:
                node = node.after.setdefault(c, _Node())
            node.piece = piece
        waiting = deque([self.root, self.inner])
        while waiting:
            node = waiting.popleft()
            for c, child in node.after.items():
                if child.piece is not None:
                    child.fail, child.pops = self.inner, [child.piece]
                else:
                    back, pops = node.fail, list(node.pops)
                    while back is not None and c not in back.after:
                        pops += back.pops
                        back = back.fail
                    if back is not None:
                        child.fail, child.pops = back.after[c], pops
                waiting.append(child)

    def pieces(self, word: str) -> list[str]:
        if self.root is None:
            self._build()
        out = self.known.get(word)
        if out is None:
            out = self._match(word) if len(word) <= LONGEST else [UNKNOWN]
            if len(self.known) < KNOWN:
                self.known[word] = out
        return out

    def _match(self, word: str) -> list[str]:
        node, out = self.root, []
        for c in word:
            while c not in node.after:
                if node.fail is None:
                    return [UNKNOWN]
                out += node.pops
                node = node.fail
            node = node.after[c]
        while node is not self.inner:
            if node.fail is None:
                return [UNKNOWN]
            out += node.pops
            node = node.fail
        return out

    def __call__(self, text: str) -> list[str]:
        return [p for w in _WORD.findall(text) for p in self.pieces(w)]

    def spans(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """(pieces, where each begins, where it ends) in characters of the text."""
        tokens, starts, ends = [], [], []
        for m in _WORD.finditer(text):
            found, at = self.pieces(m[0]), m.start()
            for p in found:
                size = len(m[0]) if p == UNKNOWN and len(found) == 1 else len(p) - len(LEAD) * (at > m.start())
                tokens.append(p)
                starts.append(at)
                ends.append(at + size)
                at += size
        return tokens, starts, ends


def vocabulary_of(pieces: DataFrame) -> Subwords:
    """The tokenizer of a table (piece string), which may have as many bytes as a table that goes to all executors."""
    if (pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0) > B.BROADCAST:
        raise ValueError("a vocabulary goes to all executors: 64 MB at most")
    return Subwords([r["piece"] for r in pieces.select("piece").distinct().collect() if r["piece"] is not None])


def subwords(docs: DataFrame, tokenizer: Subwords) -> DataFrame:
    """(doc_id, text) -> (doc_id, tokens array<string>, starts array<int>, ends array<int>) of whole texts; a null text has none."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        split = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [split.spans(t) if t is not None else ([], [], []) for t in part.column(1).to_pylist()]
                off = pa.array(np.cumsum([0, *[len(f[0]) for f in found]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array([x for f in found for x in f[k]], t)) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "tokens", "starts", "ends"])

    kept = docs.select("doc_id")
    return B.arrow(docs.select("doc_id", F.col("text").cast("string")), run, B.appended(kept, "tokens array<string>, starts array<int>, ends array<int>"))
