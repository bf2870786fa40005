"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes: A (byte-level BPE) and B (sentencepiece). All tokens of both, of many texts at once, are
sorted by the byte where they start; the running maximum of their ends says where a group breaks: where a start
reaches it. Within a group every A token is linked with every B token. Links are expanded by id, a group's repeated ids
once with their product as weight, so that a long group costs its distinct ids.

A text whose parts between single spaces hold no other white space is cut before spaces and newlines, where both tokenizers cut
as well (checked: each part's tokens must spell it), and each distinct part is encoded and coalesced once a worker;
any other text is encoded and coalesced whole.

A pair of ids counts the documents that hold it linked; copies are documents of their own. The pairs of each document are written
once. Counts of the pairs that occur most (HOT at most, 34 MB) are broadcast; the documents' other pairs meet their counts in a
shuffled join. Which pairs are broadcast follows from the counts alone and decides time, not results.

Nulls: a null text has no tokens, as an empty one and as one whose tokens don't spell a space and the text (B reads U+2581 as a
space). A null doc_id is as any other. Very long texts are handled whole, one at a time. Ties: an A id's best pairs are all those with its
highest count. Repeated rows count each. Empty table: an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: Pairs whose counts are broadcast (17 bytes each).
HOT = 2_000_000
#: Parts of texts whose groups are kept in a worker, and characters of all of them.
CACHE, CACHE_CHARS = 400_000, 12_000_000
CHUNK_CHARS = 1_500_000
#: Groups with more links than this are expanded by their distinct ids.
LONG_GROUP = 4096


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies show a byte as the character of its code if that is visible, and the rest from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ragged(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Aligned(NamedTuple):
    """Of each text: tokens, groups and links; its groups as bytes; its linked pairs (key, links), one after the other."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    shown: list[bytes]
    n_pairs: np.ndarray
    key: np.ndarray
    weight: np.ndarray


class Flat(NamedTuple):
    """Ids of several texts, one after the other, and how many each has."""

    ids: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Flat:
        return cls(np.concatenate(parts) if parts else np.empty(0, np.int64), np.fromiter(map(len, parts), np.int64, len(parts)))

    def sums(self, size: np.ndarray) -> np.ndarray:
        """Sum of a table's values over each text's ids."""
        return np.diff(np.append(0, np.cumsum(size[self.ids]))[np.append(0, np.cumsum(self.n))])


def coalesce(a: Flat, b: Flat, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, text, whether of B, group) of all tokens of A and B, ordered by group, A first; size_*: bytes of each id's token.

    Both sides spell the same bytes, so that the texts lie one after the other for A and for B alike.
    """
    ids = np.concatenate([a.ids, b.ids])
    texts = np.concatenate([np.repeat(np.arange(len(x.n)), x.n) for x in (a, b)])
    kinds = np.repeat([0, 1], [len(a.ids), len(b.ids)])
    sizes = np.concatenate([size_a[a.ids], size_b[b.ids]])
    ends = np.concatenate([np.cumsum(sizes[: len(a.ids)]), np.cumsum(sizes[len(a.ids) :])])
    order = np.lexsort((kinds, ends - sizes))
    starts = (ends - sizes)[order]
    reached = np.maximum.accumulate(ends[order]) if len(order) else order
    group = np.cumsum(np.append(0, starts[1:] >= reached[:-1])) if len(order) else order
    inner = np.lexsort((kinds[order], group))
    order = order[inner]
    return ids[order], texts[order], kinds[order], group[inner]


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 .. n-1 as bytes, filled with 0 at the end; one column is left for a mark."""
    text = np.array([str(i).encode() for i in range(n)])
    return np.concatenate([text.view(np.uint8).reshape(n, -1), np.zeros((n, 1), np.uint8)], axis=1)


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for t, i in vocab.items():
            self.bytes_a[i] = t.encode() if t in special else bytes(byte_of[c] for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.begins_a = np.array([x[:1] in (b" ", b"\n") for x in self.bytes_a])
        self.begins_b = np.array([x[:1] in (b" ", b"\n") for x in self.bytes_b])
        self.ids_b = len(pieces)
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.digits = _digits(top)
        #: Texts can be cut only if no piece of B has a space behind another character.
        self.cuts = all(SPACE not in p[1:] or set(p) == {SPACE} for p in pieces) and self.b.normalize("a b") == f"{SPACE}a{SPACE}b"
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.kept: list[bytes] = []
        self.chars = self.pairs = 0
        #: Tokens of A and B, groups, links, pairs, and the place of the pairs.
        self.row = np.zeros((1024, 6), np.int64)
        self.key, self.weight = np.zeros(4096, np.int64), np.zeros(4096, np.int64)

    def _ids_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]

    def align(self, a: Flat, b: Flat) -> Aligned:
        n = len(a.n)
        ids, text, kind, group = coalesce(a, b, self.size_a, self.size_b)
        count = lambda of: np.bincount(text[of], minlength=n)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        of_b = np.add.reduceat(kind, first) if len(first) else first
        size = np.diff(np.append(first, len(ids)))
        of_a = size - of_b
        links = of_a * of_b
        # What stands behind each token: , within a side, | between the sides, ; between groups, nothing at the end of a text.
        wide = self.digits[ids]
        same = group[1:] == group[:-1]
        mark = np.where(same, np.where(kind[1:] == kind[:-1], ord(","), ord("|")), np.where(text[1:] == text[:-1], ord(";"), 0)) if len(ids) else ids
        used = (wide != 0).sum(1)
        wide[np.arange(len(ids) - 1), used[:-1]] = mark
        length = used
        length[:-1] += mark != 0
        flat = wide[wide != 0].tobytes()
        cut = np.append(0, np.cumsum(np.bincount(text, weights=length, minlength=n))).astype(np.int64)
        shown = [flat[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        keys, weights, texts = [], [], []
        short = links <= LONG_GROUP
        g = np.flatnonzero(short)
        m = links[g]
        place = _ragged(m)
        at, by = np.repeat(first[g], m), np.repeat(of_b[g], m)
        left, right = at + place // np.maximum(by, 1), at + np.repeat(of_a[g], m) + place % np.maximum(by, 1)
        keys.append(ids[left] * self.ids_b + ids[right])
        weights.append(np.ones(len(left), np.int64))
        texts.append(text[left])
        for g in np.flatnonzero(~short):
            i, j, k = first[g], first[g] + of_a[g], first[g] + size[g]
            (x, nx), (y, ny) = np.unique(ids[i:j], return_counts=True), np.unique(ids[j:k], return_counts=True)
            keys.append((x[:, None] * self.ids_b + y).ravel())
            weights.append((nx[:, None] * ny).ravel())
            texts.append(np.full(len(keys[-1]), text[i]))
        n_pairs, key, weight = self._distinct(np.concatenate(texts), np.concatenate(keys), np.concatenate(weights), n)
        return Aligned(count(kind == 0), count(kind == 1), count(first), np.bincount(text[first], weights=links, minlength=n).astype(np.int64), shown, n_pairs, key, weight)

    @staticmethod
    def _distinct(text: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of each text, each once, with the sum of its weights; in order."""
        order = np.lexsort((key, text))
        text, key, weight = text[order], key[order], weight[order]
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[: len(key)])
        return np.bincount(text[new], minlength=n), key[new], np.add.reduceat(weight, new) if len(new) else weight

    def _spells(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        want = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == want == b"".join(map(self.bytes_b.__getitem__, b.tolist()))

    def whole(self, texts: list[str]) -> Aligned:
        a, b = self._ids_a([" " + t for t in texts]), self._ids_b(texts)
        none = np.empty(0, np.int64)
        for i, t in enumerate(texts):
            if not t or not self._spells(a[i], b[i], " " + t):
                a[i] = b[i] = none
        return self.align(Flat.of(a), Flat.of(b))

    @staticmethod
    def _cut(ids: np.ndarray, begins: np.ndarray) -> Flat:
        """Ids of joined parts, cut where a token begins a part."""
        first = np.flatnonzero(begins[ids])
        return Flat(ids, np.diff(np.append(first, len(ids))))

    def _learn(self, parts: list[str]) -> list[str]:
        """Encode and coalesce parts not known yet; returns those that can't be taken apart from their text."""
        odd = []
        for at in range(0, len(parts), 5000):
            some = parts[at : at + 5000]
            joined = "".join([p if p[0] == "\n" else " " + p for p in some])
            # B puts a space in front of its text. Before a newline it stands alone, and goes.
            a, b = self._ids_a([joined])[0], self._ids_b([joined[1:] if joined[0] == " " else joined])[0]
            a, b = self._cut(a, self.begins_a), self._cut(b[1:] if joined[0] == "\n" else b, self.begins_b)
            size = np.fromiter((len(p.encode()) + (p[0] != "\n") for p in some), np.int64, len(some))
            fits = len(a.n) == len(b.n) == len(some) and (a.sums(self.size_a) == size).all() and (b.sums(self.size_b) == size).all()
            if fits and self._spells(a.ids, b.ids, joined):
                self._keep(some, self.align(a, b))
            elif len(some) > 1:
                odd += self._learn(some[: len(some) // 2]) + self._learn(some[len(some) // 2 :])
            else:
                odd += some
        return odd

    def _keep(self, parts: list[str], x: Aligned) -> None:
        n, m = len(self.known), len(parts)
        while n + m > len(self.row):
            self.row = np.concatenate([self.row, np.zeros_like(self.row)])
        while self.pairs + len(x.key) > len(self.key):
            self.key, self.weight = (np.concatenate([y, np.zeros_like(y)]) for y in (self.key, self.weight))
        self.row[n : n + m] = np.stack([x.n_a, x.n_b, x.n_groups, x.n_links, x.n_pairs, self.pairs + np.cumsum(x.n_pairs) - x.n_pairs], 1)
        self.key[self.pairs : self.pairs + len(x.key)] = x.key
        self.weight[self.pairs : self.pairs + len(x.key)] = x.weight
        self.pairs += len(x.key)
        self.kept += x.shown
        self.chars += sum(map(len, parts))
        self.known.update(zip(parts, range(n, n + m)))

    @staticmethod
    def _regular(part: str) -> bool:
        bare = part[1:] if part[:1] == "\n" else part
        return bare.split() == [bare] and SPACE not in bare and "\0" not in bare

    def __call__(self, texts: list[str]) -> Aligned:
        parts = [t.replace("\n", " \n").split(" ") if t and self.cuts else [] for t in texts]
        distinct = set(chain.from_iterable(parts))
        new = [p for p in distinct if p not in self.known]
        odd = {p for p in new if not self._regular(p)}
        new = [p for p in new if p not in odd]
        if len(self.known) + len(new) > CACHE or self.chars + sum(map(len, new)) > CACHE_CHARS:
            self.reset()
            new = [p for p in distinct - odd if self._regular(p)]
        odd.update(self._learn(new))
        aside = np.array([not p or not odd.isdisjoint(p) or p[0] == "" or p[0][0] == "\n" for p in parts], bool)
        apart = [p for p, x in zip(parts, aside) if not x]
        sizes = np.fromiter(map(len, apart), np.int64, len(apart))
        k = np.fromiter(map(self.known.__getitem__, chain.from_iterable(apart)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(apart)), sizes)
        ends = np.cumsum(sizes).tolist()
        names = list(map(self.kept.__getitem__, k.tolist()))
        shown = [b";".join(names[i:j]) for i, j in zip([0, *ends[:-1]], ends)]
        # A part that a text holds several times brings its pairs once, with that weight.
        seen, times = np.unique(text * (len(self.kept) + 1) + k, return_counts=True)
        of, part = seen // (len(self.kept) + 1), seen % (len(self.kept) + 1)
        n = self.row[part, 4]
        at = np.repeat(self.row[part, 5], n) + _ragged(n)
        n_pairs, key, weight = self._distinct(np.repeat(of, n), self.key[at], self.weight[at] * np.repeat(times, n), len(apart))
        sums = [np.bincount(text, weights=self.row[k, c], minlength=len(apart)).astype(np.int64) for c in range(4)]
        mine = Aligned(*sums, shown, n_pairs, key, weight)
        return self._merged(aside, self.whole([t for t, x in zip(texts, aside) if x]), mine)

    @staticmethod
    def _merged(aside: np.ndarray, whole: Aligned, apart: Aligned) -> Aligned:
        """Both in the order of the texts."""
        order = np.argsort(np.concatenate([np.flatnonzero(aside), np.flatnonzero(~aside)]))
        shown = whole.shown + apart.shown
        both = [np.concatenate([x, y])[order] for x, y in zip(whole[:4], apart[:4])]
        n = np.concatenate([whole.n_pairs, apart.n_pairs])
        first = (np.cumsum(n) - n)[order]
        at = np.repeat(first, n[order]) + _ragged(n[order])
        return Aligned(*both, [shown[i] for i in order], n[order], np.concatenate([whole.key, apart.key])[at], np.concatenate([whole.weight, apart.weight])[at])


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "


def _scan(path_a: str, path_b: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) < CHUNK_CHARS):
                    size += len(texts[b])
                    b += 1
                x = al(texts[a:b])
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in x.shown]
                off = pa.array(np.append(0, np.cumsum(x.n_pairs)).astype(np.int32))
                cols = [pa.array(np.arange(row + a, row + b)), batch.column("doc_id").slice(a, b - a), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(sha, pa.string())]
                cols += [pa.ListArray.from_arrays(off, pa.array(x.key.astype(kind.to_pandas_dtype()))), pa.ListArray.from_arrays(off, pa.array(x.weight.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "links"])
                a = b
            row += len(texts)

    return run


def _hot(pairs: DataFrame, hot: int) -> tuple[int, int]:
    """(least count of the pairs to broadcast, a power of two; pairs below it): those of the highest counts, `hot` at most."""
    sizes = {r.e: r.n for r in pairs.groupBy(F.length(F.bin("n")).alias("e")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    low, n = 64, 0
    while low > 1 and n + sizes.get(low - 1, 0) <= hot:
        low -= 1
        n += sizes.get(low, 0)
    return 1 << (low - 1), sum(sizes.values()) - n


def _sums(shared):
    """n_best and count_sum over the broadcast pairs; the other pairs as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            keys, links = batch.column("keys"), batch.column("links")
            n = np.diff(keys.offsets.to_numpy())
            lo, hi = keys.offsets[0].as_py(), keys.offsets[-1].as_py()
            key, w = keys.values.to_numpy()[lo:hi], links.values.to_numpy()[links.offsets[0].as_py() : links.offsets[-1].as_py()].astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            hit = known[at] == key if len(known) else np.zeros(len(key), bool)
            at = at[hit]
            # Sums of whole numbers: exact, not in doubles.
            total, good = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            np.add.at(total, row[hit], w[hit] * count[at])
            np.add.at(good, row[hit], w[hit] * best[at])
            off = pa.array(np.append(0, np.cumsum(np.bincount(row[~hit], minlength=len(n)))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(off, pa.array(x[~hit])) for x in (key, w.astype(np.int32))]
            cols = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")] + [pa.array(good), pa.array(total), *rest]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "keys", "links"])

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the pairs (a, b, n, best)."""
    spark, al = docs.sparkSession, aligner(path_a, path_b)
    wide = len(al.bytes_a) * al.ids_b >= 1 << 31
    kind = "long" if wide else "int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = common.materialise(rows.mapInArrow(_scan(path_a, path_b, pa.int64() if wide else pa.int32()), f"{_ROW}keys array<{kind}>, links array<int>"), "align-rows")
    pairs = scanned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    pairs = common.materialise(pairs.withColumn("a", F.expr(f"key div {al.ids_b}").cast("int")), "align-counts")
    highest = pairs.groupBy("a").agg(F.max("n").alias("_most"))
    pairs = pairs.join(F.broadcast(highest), "a").withColumn("best", F.col("n") == F.col("_most")).drop("_most")  # a row an id of A: the vocabulary bounds it
    least, below = _hot(pairs, hot)
    top = pairs.filter(F.col("n") >= least).select("key", "n", "best").toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((top.column("key").to_numpy(), top.column("n").to_numpy(), top.column("best").to_numpy().astype(np.int64)))
    out = scanned.mapInArrow(_sums(shared), f"{_ROW}n_best long, count_sum long, keys array<{kind}>, links array<int>")
    if below:
        out = common.materialise(out, "align-sums")
        rest = out.select("row", F.explode(F.arrays_zip("keys", "links")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.links").alias("_w"))
        rest = rest.join(pairs.filter(F.col("n") < least).select("key", "n", "best").hint("merge"), "key")
        rest = rest.groupBy("row").agg(F.sum(F.col("_w") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("_w")).otherwise(0)).alias("_good"))
        out = out.join(rest.hint("merge"), "row", "left")
        out = out.withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_good", F.lit(0))})
    ids = pairs.select("a", F.expr(f"key % {al.ids_b}").cast("int").alias("b"), "n", "best")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), ids


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))[0]


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES = {}
