"""Token counts by rank-synchronous array merging, for sentencepiece BPE models with byte fallback.

Texts are cut into pre-tokens that no piece of the vocabulary crosses: words with the space before them, parts that begin
with a newline, and runs of further spaces. Distinct pre-tokens of a batch are held as ragged numpy arrays of symbols.
In a round every sequence finds its lowest-rank pair and merges it, all sequences at once; a pair's rank is the place of
its piece by score. All occurrences of the pair in the sequence merge in the same round, left to right, unless a merge
could make a pair of lower or equal rank (a fixed set of pieces, found from the vocabulary): of these the leftmost only. So the
order is that of the library's queue. When no sequence has a pair, the surviving symbols are counted; a character
without a piece counts its UTF-8 bytes.

Counts of pre-tokens are kept from batch to batch up to CACHE entries and CACHE_CHARS characters; this changes time, not results.
Nulls: a null text is empty and has no tokens. Very long texts are counted whole. Ties (pairs of one rank) merge from the left.
Empty table: an empty result. Repeated rows count each; no other column
than doc_id and text is read. A lone surrogate can't occur in a Parquet string.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE, CACHE_CHARS = 400_000, 40_000_000
SPACE = "▁"
NONE = np.int64(1 << 40)


class Merger:
    """A model's pieces as arrays: pair of symbols -> rank and merged symbol."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(m.vocab_size()):
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                pieces[m.id_to_piece(i)] = m.get_score(i)
        if m.normalize("a  b　ﬁ") != f"{SPACE}a{SPACE}{SPACE}b　ﬁ":
            raise ValueError("only models that leave texts as they are, but for a space in front, are supported")
        words = {p: s for p, s in pieces.items() if set(p) != {SPACE} or len(p) == 1}
        runs = [p for p in pieces if set(p) == {SPACE} and len(p) > 1]
        low = min((s for p, s in words.items() if len(p) > 1), default=0.0)
        if any(SPACE in p[1:] for p in words) or len({pieces[p] for p in runs}) > 1 or any(pieces[p] >= low for p in runs):
            raise ValueError("pieces cross words, or runs of spaces don't merge after all other pieces")
        self.runs = self._run_table({len(p) for p in runs})
        scores = sorted(set(words.values()), reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        self.symbol = {p: i for i, p in enumerate(words)}
        self.ranks = np.array([rank[s] for s in words.values()], np.int64)
        self.n = len(words)
        left, right, made = [], [], []
        late = np.zeros(self.n, bool)
        for p, i in self.symbol.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
                    late[a] |= self.ranks[i] <= self.ranks[a]
                    late[b] |= self.ranks[i] <= self.ranks[b]
        for same in np.flatnonzero(np.bincount(self.ranks) > 1):
            late[self.ranks == same] = True
        self.one_by_one = late
        keys = np.array(left, np.int64) * self.n + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, np.int64)[order]
        self.counts: dict[str, int] = {}
        self.chars = 0

    @staticmethod
    def _run_table(sizes: set[int]) -> np.ndarray:
        """Tokens of 0, 1, 2 ... spaces in a row: the pieces tie, so the leftmost pair merges first. Checked to be periodic."""
        top = max(sizes, default=1)
        out = []
        for n in range(5 * top):
            cur = [1] * n
            while (i := next((i for i in range(len(cur) - 1) if cur[i] + cur[i + 1] in sizes), None)) is not None:
                cur[i : i + 2] = [cur[i] + cur[i + 1]]
            out.append(len(cur))
        if any(out[n + top] != out[n] + 1 for n in range(4 * top)):
            raise ValueError("runs of spaces aren't periodic")
        return np.array(out[:top], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbol made of each pair, or -1. Symbols from n on are characters without a piece."""
        key = np.where((a < self.n) & (b < self.n), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, whether the first symbol is a bare space mark) of each pre-token."""
        total = np.zeros(len(words), np.int64)
        bare = np.zeros(len(words), bool)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars, code = np.unique(text, return_inverse=True)
        ids = np.array([self.symbol.get(chr(c), self.n + max(1, len(chr(c).encode()))) for c in chars], np.int64)
        sym = ids[code] if len(text) else np.empty(0, np.int64)
        seq = np.repeat(np.arange(len(words)), lengths)
        made = self.pair(sym[:-1], sym[1:]) if len(sym) else sym
        made = np.append(np.where(seq[:-1] == seq[1:], made, -1), -1) if len(sym) else sym
        space = self.symbol.get(SPACE, -1)

        def settle(done: np.ndarray) -> None:
            cost = np.where(sym >= self.n, sym - self.n, 1)[done]
            np.add.at(total, seq[done], cost)
            first = done & (np.diff(seq, prepend=-1) != 0)
            bare[seq[first]] = sym[first] == space

        while len(sym):
            rank = np.where(made >= 0, self.ranks[made], NONE)
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(seq)))
            low = np.repeat(low, size)
            over = low == NONE
            if over.any():
                settle(over)
                stay = ~over
                sym, seq, made, rank, low = sym[stay], seq[stay], made[stay], rank[stay], low[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            # Overlapping occurrences: of a chain of hits in a row, every second one merges.
            far = np.diff(hit, prepend=-9) != 1
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(far, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            single = self.one_by_one[made[hit]]
            if single.any():
                hit = hit[~single | (np.diff(seq[hit], prepend=-1) != 0)]
            sym = sym.copy()
            sym[hit] = made[hit]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            touched = np.zeros(len(sym), bool)
            touched[hit] = True
            before = hit - 1
            keep = ~gone
            # The symbol before a merged pair gets a new neighbour too; if it was taken in, it is a merge of its own.
            before = before[before >= 0]
            back = np.where(gone[before], before - 1, before)
            touched[back] = True
            sym, seq, made, touched = sym[keep], seq[keep], made[keep], touched[keep]
            at = np.flatnonzero(touched)
            nxt = np.minimum(at + 1, len(sym) - 1)
            new = self.pair(sym[at], sym[nxt])
            made[at] = np.where((nxt > at) & (seq[at] == seq[nxt]), new, -1)
        return total, bare

    def lookup(self, parts: list[str]) -> np.ndarray:
        """2 * tokens + bare for every pre-token; those not known yet are merged together."""
        known = self.counts
        new = list({p for p in parts if p not in known})
        chars = sum(map(len, new))
        if len(known) + len(new) > CACHE or self.chars + chars > CACHE_CHARS:
            known.clear()
            new = list(set(parts))
            self.chars, chars = 0, sum(map(len, new))
        self.chars += chars
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            n, bare = self.merge([p if p[:1] == "\n" else SPACE + p for p in some])
            known.update(zip(some, (2 * n + bare).tolist()))
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def run(self, n: np.ndarray) -> np.ndarray:
        """Tokens of n spaces in a row."""
        return n // len(self.runs) + self.runs[n % len(self.runs)]

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A part that begins with a newline has no space before it."""
        split = [t.replace(SPACE, " ").replace("\n", " \n").split(" ") if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(texts))
        parts = [p for s in split for p in s]
        if not parts:
            return np.zeros(len(texts), np.int64)
        got = self.lookup(parts)
        n, bare = got >> 1, got & 1
        text = np.repeat(np.arange(len(texts)), sizes)
        empty = np.fromiter((not p for p in parts), bool, len(parts))
        count = np.where(empty, 0, n)
        if empty.any() or bare.any():
            # Spaces in a row: the empty parts before a part, and its own mark where nothing merged with it.
            led = np.fromiter((p[:1] == "\n" for p in parts), bool, len(parts))
            count = count - np.where(empty, 0, bare)
            ends = ~empty | (np.append(text[1:], -1) != text)
            group = np.cumsum(ends) - ends
            spaces = np.bincount(group, weights=empty).astype(np.int64)
            last = np.flatnonzero(ends)
            spaces += np.where(empty[last] | led[last], 0, bare[last])
            count[last] += self.run(spaces)
        return np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            out, at = [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 2_000_000):
                    size += len(texts[to])
                    to += 1
                out.append(m.tokens(texts[at:to]))
                at = to
            n = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens. path: the model file, readable on every executor."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counter(path), f"doc_id {kind}, n_bytes long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES = {}
