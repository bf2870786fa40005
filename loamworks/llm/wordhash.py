"""Hashes of words, lines and word windows of many texts at once, as numpy arrays over one byte buffer.

Words end at the six ASCII separators only, which never occur inside a UTF-8 sequence, so bytes are enough. A word's hash
is a polynomial over random 64-bit values of its bytes, mixed; hashes are equal for equal words and collide with
probability about 2**-64 a pair otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are handled in chunks of about this many bytes (one text at least), which bounds memory.
CHUNK_BYTES = 3_000_000
_rng = np.random.default_rng(0x10A3)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = U(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """_BASE**0 ... _BASE**(n-1), wrapping."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _BASE, U)
        steps[0] = U(1)
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(values: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts as bytes) of a string array; null texts are empty."""
    texts = [b"" if x is None else x for x in values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()]
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK_BYTES:
            yield start, i, texts[start:i]
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts), texts[start:]


def _sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of `lengths` consecutive values; runs lie one after the other and none is empty."""
    return np.add.reduceat(values, np.cumsum(lengths) - lengths) if len(starts) else np.empty(0, values.dtype)


class Texts:
    """Words of a chunk of texts: `start` and `end` (bytes of `data`), `doc` (index of the text), `word` (hash)."""

    def __init__(self, texts: list[bytes], fold: bool) -> None:
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        inside = ~_IS_SEP[self.data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        at = np.flatnonzero(inside)
        lengths = self.end - self.start
        place = at - np.repeat(self.start, lengths)
        table = _FOLDED if fold else _BYTES
        raw = _sums(table[self.data[at]] * powers(int(lengths.max(initial=0)) + 1)[place], self.start, lengths)
        self.word = mix(raw + lengths.astype(U))
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.words = np.bincount(self.doc, minlength=self.n)
        self.word_at = np.cumsum(self.words) - self.words

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of `size` words that lies in one text."""
        m = len(self.word) - size + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, U)
        at = np.flatnonzero(self.doc[:m] == self.doc[size - 1 :])
        h = np.full(len(at), seed, U)
        for k in range(size):
            h += self.word[at + k] * _STEPS[k % 64]
        return at, mix(h)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all shingles, sorted and distinct; a text with fewer words has its whole sequence as one."""
        at, h = self.windows(size)
        doc = self.doc[at]
        short = []
        for n in range(1, size):
            of = np.flatnonzero(self.words == n)
            if len(of):
                g = np.full(len(of), n, U)
                for k in range(n):
                    g += self.word[self.word_at[of] + k] * _STEPS[32 + k]
                short.append((of, mix(g)))
        if short:
            doc = np.concatenate([doc, *[x for x, _ in short]])
            h = np.concatenate([h, *[x for _, x in short]])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        return doc[new], h[new]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every line with a word: text, number of the line in it, words, hash of its bytes, hash of its folded words.

        The last needs fold=True texts to ignore case; white space never counts in it.
        """
        ends = np.flatnonzero(self.data == 10)
        line = np.searchsorted(ends, self.start)
        if not len(line):
            none = np.empty(0, np.int64)
            return none, none, none, none.astype(U), none.astype(U)
        firsts = np.flatnonzero(np.diff(line, prepend=-1))
        words = np.diff(np.append(firsts, len(line)))
        of = line[firsts]
        doc = self.doc[firsts]
        line_of_doc = np.searchsorted(ends, self.first)
        place = np.arange(len(line)) - np.repeat(firsts, words)
        normal = mix(_sums(self.word * powers(int(words.max()) + 1)[place], firsts, words) + words.astype(U))
        begin = np.where(of > 0, ends[of - 1] + 1, 0)
        size = ends[of] - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        place = at - np.repeat(begin, size)
        raw = mix(_sums(_BYTES[self.data[at]] * powers(int(size.max()) + 1)[place], begin, size) + size.astype(U))
        return doc, of - line_of_doc[doc], words, raw, normal


def per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each text's part in arrays sorted by text."""
    return np.searchsorted(doc, np.arange(n + 1))


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
