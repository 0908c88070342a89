"""Whole texts to token ids with the ``tokenizers`` library, one chunk of text at a time.

Both vocabularies split a text into pieces that never reach over certain cuts, so a text's ids are its chunks' ids
in a row. An Arrow batch is cut there in numpy, its chunks are numbered by Arrow's dictionary encoding, and only
chunks that a worker has not met lately go through the library: in natural text that is a few of a hundred.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import bounds

#: Chunks that a worker keeps with their ids; twice as many at most.
KEEP = 100_000
#: Bytes of text whose chunks are numbered together.
SLICE = 1 << 22
#: 1: ASCII letters and digits, 2: ASCII punctuation, 3: the apostrophe, 0: all else.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x27] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: White space beyond ASCII (and the four separators that some tables count as white space): such texts are not cut.
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True



@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level BPE files: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def rank_tokenizer(path: str):
    """A byte-level BPE tokenizer of the ``tokenizers`` library for a file of ranks.

    The ranks say which joined token comes first, so every way to split a token into two tokens becomes a merge of
    its rank. Of several ways the one with the longer left part comes first.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ranks, alphabet = read_ranks(path), byte_alphabet()
    text = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = [(text[t[:i]], text[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(len(t) - 1, 0, -1) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE({text[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return out


@lru_cache(maxsize=4)
def file_tokenizer(path: str):
    """A tokenizer file as the library reads it: a special token's own string in a text becomes that token."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def _odd(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins."""
    at = np.flatnonzero(_LEADS[data])
    if not len(at):
        return at
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    quads = (b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    ogham = (b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)
    hit = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ogham | (a == 0xE2) & quads
    return at[hit | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)]


class ChunkEncoder:
    """Ids of the rows of a batch.

    No piece of either vocabulary reaches from the end of a word into the white space after it, and a run of white
    space is split by what follows it: so with ``spaced`` a chunk is a word with the white space before it. Without,
    white space has no ids, and words are chunks of their own.
    """

    def __init__(self, tokenizer, spaced: bool):
        self.tokenizer, self.spaced = tokenizer, spaced
        self.table = dict(enumerate(byte_alphabet()))
        #: Strings that the library takes out of a text before all else, and their ids.
        self.special = {t.content.encode(): array("I", [i]).tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.old: dict[bytes, bytes] = {}
        self.new: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit words. A word of Latin letters is one piece and goes to the library's model at once, the others through its whole chain as words of one input."""
        out: list[bytes] = []
        model, table, rest = self.tokenizer.model, self.table, []
        for i, text in enumerate(texts):
            body = text[1:] if self.spaced and text[0] == " " else text
            if body.isalpha() and max(body) < "\u0250" and (self.spaced or body == body.lower()):
                out.append(array("I", [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(table))]).tobytes())
            else:
                out.append(b"")
                rest.append(i)
        if rest:
            done = self.tokenizer.encode([texts[i] for i in rest], is_pretokenized=True, add_special_tokens=False)
            ids, of = array("I", done.ids).tobytes(), np.array(done.word_ids, dtype=np.int64)
            upto = (4 * np.searchsorted(of, np.arange(len(rest) + 1))).tolist()
            for i, a, b in zip(rest, upto[:-1], upto[1:], strict=True):
                out[i] = ids[a:b]
        return out

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Offsets that tile the bytes with chunks, those of the rows among them."""
        starts, ends, _ = bounds(data, off)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        edge[ends] = True
        if not self.spaced:
            edge[starts] = True
            # A piece of letters or digits ends before ASCII punctuation, and one of punctuation before letters and
            # digits, but for an apostrophe, which may begin an ending such as 's.
            kind = _KIND[data]
            edge[1:-1] |= (kind[:-1] == 1) & (kind[1:] >= 2) | (kind[:-1] == 2) & (kind[1:] == 1)
        return np.flatnonzero(edge)

    def _specials(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Where special strings stand in the rows, the longer one first of two at one place."""
        raw, found = data.tobytes(), []
        for m in re.finditer(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), raw) if self.special else ():
            if np.searchsorted(off, m.start(), side="right") == np.searchsorted(off, m.end() - 1, side="right"):
                found.append(m.span())
        return found

    def batch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(ids, row offsets in ids, chunk numbers, distinct chunks, row offsets in chunks)."""
        rows = len(off) - 1
        special = self._specials(data, off)
        if not self.spaced:
            data = _LOWER[data]  # the vocabulary is lower case, and so are its special strings
        cuts = self._cuts(data, off) if len(data) else np.zeros(1, np.int64)
        if special:
            # A special string is one chunk; that of other texts cannot be equal to it, as they are cut inside it.
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[cuts] = True
            for a, b in special:
                edge[a + 1 : b] = False
                edge[[a, b]] = True
            cuts = np.flatnonzero(edge)
        odd = _odd(data) if self.spaced else ()
        if len(odd):
            whole = np.unique(np.searchsorted(off, odd, side="right") - 1)
            inside = np.searchsorted(off, cuts, side="right") - 1
            cuts = cuts[~np.isin(inside, whole) | np.isin(cuts, off)]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        chunks, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found: list[bytes | None] = [self.special.get(c, self.new.get(c)) for c in chunks]
        missing = []
        for i, c in enumerate(chunks):
            if found[i] is None:
                known = self.old.get(c)
                if known is None:
                    missing.append(i)
                else:
                    found[i] = self.new[c] = known
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for i, ids in zip(part, self.encode([chunks[i].decode() for i in part]), strict=True):
                found[i] = ids
                if len(chunks[i]) < 64:
                    self.new[chunks[i]] = ids
        if len(self.new) > KEEP:
            self.old, self.new = self.new, {}
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        joined = np.frombuffer(b"".join(found), dtype=np.uint32)
        begin = np.cumsum(sizes) - sizes
        each = sizes[numbers]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = joined[np.repeat(begin[numbers] - upto[:-1], each) + np.arange(upto[-1])]
        first = np.searchsorted(cuts[:-1], off) if rows else np.zeros(1, np.int64)
        return ids, upto[first], numbers, coded.dictionary, first
