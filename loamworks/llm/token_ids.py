"""Token-ID files coded by a static range asymmetric numeral system (rANS).

Documents are dealt into ranges of ascending doc_id. Each range is tokenised and written as segments of up to
SEGMENT_IDS ids. A segment has one frequency table, shared by its blocks. Blocks of LANES * STEPS ids are coded
independently, each by LANES interleaved states; a block's checkpoint (its states, the place of its words and the
crc32 of its ids) lets any block be decoded alone and in parallel with the others. All blocks of a segment are coded
in lockstep as numpy arrays.

A segment (little-endian): magic `LWR1`, then u32: ids, distinct ids, blocks, words; the table (u32 id, u32 frequency
out of 2**18 each), checkpoints (per block LANES u64 states, u32 first word, u32 crc32), the words (u32), and a u32 crc32
of all before. Segments are rows of a Parquet table with the index of their documents (doc_ids, lengths) beside them.

Nulls: a null text is empty (its end id only); null doc_ids come first. Ties in doc_id are ordered by text hash, repeated
rows stay repeated. Very long texts are encoded whole, one at a time. Empty table: no segments. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Words whose ids are kept (about 150 bytes each), and characters of all of them.
CACHE, CACHE_CHARS = 1_000_000, 60_000_000
#: A run of these behind a letter is a pre-token of its own (no apostrophe: it may begin a contraction).
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
SEGMENT_IDS = 4_000_000
LANES, STEPS = 32, 512
BITS = 18
MAGIC = b"LWR1"
LOW = np.uint64(1 << 31)


class Encoder:
    """A byte-level BPE tokenizer whose results for words are kept; ids equal the library's for the whole text.

    A text whose words are parted by single spaces or newlines is cut before them, where the pre-tokenizer cuts as well,
    and each distinct word goes through the library once. Any other text goes through it whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.spaced = [s for s in self.special if s.split() != [s]]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        #: Tokens that begin with the byte of a space or a newline: with these a word begins.
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[:1] in ("Ġ", "Ċ")]] = True
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.at = np.zeros(2 * CACHE + 1, np.int64)
        self.used = self.chars = 0
        self.tails: dict[str, list[int]] = {}

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.known)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(words)] = self.used + ends
        self.used += len(ids)
        self.chars += sum(map(len, words))
        self.known.update(zip(words, range(n, n + len(words))))

    def _learn(self, new: list[str]) -> None:
        """A word with marks behind a letter is its bare word's ids and those of the marks: the pre-tokenizer always cuts there."""
        marked, bare = [], []
        for p in new:
            b = p.rstrip(MARKS)
            if b and b != p and b[-1].isalpha():
                marked.append(p)
                bare.append(b)
        if marked:
            self._library(list({p for p in bare if p not in self.known}))
            tails = [p[len(b) :] for p, b in zip(marked, bare)]
            more = list({x for x in tails if x not in self.tails})
            for x, e in zip(more, self.tok.encode_batch_fast(more, add_special_tokens=False)):
                self.tails[x] = e.ids
            k = np.array([self.known[p] for p in bare], np.int64)
            size = self.at[k + 1] - self.at[k]
            behind = [self.tails[x] for x in tails]
            length = np.fromiter(map(len, behind), np.int64, len(behind))
            ends = np.cumsum(size + length)
            ids = np.empty(int(ends[-1]), np.uint32)
            of = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ids[np.repeat(ends - size - length, size) + of] = self.flat[np.repeat(self.at[k], size) + of]
            of = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            ids[np.repeat(ends - length, length) + of] = np.fromiter(chain.from_iterable(behind), np.uint32, int(length.sum()))
            self._keep(marked, ids, ends)
        self._library([p for p in new if p not in self.known])

    def _library(self, new: list[str]) -> None:
        heads = [p for p in new if p[0] == "\0"]
        for p, e in zip(heads, self.tok.encode_batch_fast([p[1:] for p in heads], add_special_tokens=False)):
            self._keep([p], np.array(e.ids, np.uint32), np.array([len(e.ids)]))
        rest = [p for p in new if p[0] != "\0"]
        for a in range(0, len(rest), 2000):
            some = rest[a : a + 2000]
            text = "".join([p if p[0] == "\n" else " " + p for p in some])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(self.begins[ids])[1:], len(ids))
            if len(ends) != len(some):
                raise ValueError("the pre-tokenizer doesn't cut before single spaces and newlines")
            self._keep(some, ids, ends)

    def _regular(self, word: str) -> bool:
        """Whether a part between spaces is a word: not empty, and no white space, NUL or special string in it but the mark in front."""
        bare = word[1:] if word[:1] in ("\0", "\n") else word
        return bare.split() == [bare] and "\0" not in bare and not any(s in bare for s in self.special)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with END_ID behind each text, ids of each text with it)."""
        some = np.array([i for i, t in enumerate(texts) if t], np.int64)
        # Arrow parts the texts at spaces and finds the distinct words; a text's first word, without a space before it, is marked by NUL.
        split = pc.split_pattern(pa.array(["\0" + texts[i].replace("\n", " \n") for i in some], pa.string()), " ")
        words = split.values.dictionary_encode()
        distinct, index = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
        of = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        odd = np.zeros(len(distinct), bool)
        unknown = np.flatnonzero(of < 0)
        odd[unknown] = [not self._regular(distinct[j]) for j in unknown]
        row = np.repeat(np.arange(len(some)), sizes)
        aside = np.zeros(len(some), bool)
        aside[row[odd[index]]] = True
        aside |= [any(x in texts[i] for x in self.spaced) for i in some] if self.spaced else False
        whole = {int(i): np.array(self.tok.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, np.uint32) for i in some[aside]}
        count = np.zeros(len(texts), np.int64)
        count[some] = np.where(aside, 0, sizes)
        index = index[~aside[row]]
        needed = np.zeros(len(distinct), bool)
        needed[index] = True
        new = np.flatnonzero(needed & (of < 0))
        if len(new):
            fresh = [distinct[j] for j in new]
            if len(self.known) + len(new) > CACHE or self.chars + sum(map(len, fresh)) > CACHE_CHARS:
                self.reset()
                new = np.flatnonzero(needed)
                fresh = [distinct[j] for j in new]
                if 2 * len(new) > len(self.at):
                    self.at = np.zeros(2 * len(new) + 1, np.int64)
            self._learn(fresh)
            of[new] = [self.known[p] for p in fresh]
        k = of[index]
        size = self.at[k + 1] - self.at[k]
        ends = np.cumsum(size)
        words = self.flat[np.repeat(self.at[k] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        first = np.append(0, np.cumsum(count))
        cut = np.append(0, ends)[first]
        n = np.diff(cut)
        for i, ids in whole.items():
            n[i] = len(ids)
        n += 1
        out = np.full(int(n.sum()), END_ID, np.uint32)
        to = np.cumsum(n) - n
        plain = np.ones(len(texts), bool)
        plain[list(whole)] = False
        of = np.flatnonzero(plain)
        m = n[of] - 1
        out[np.repeat(to[of] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] = words
        for i, ids in whole.items():
            out[to[i] : to[i] + len(ids)] = ids
        return out, n


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and their frequencies, which sum to 2**BITS and are at least 1."""
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << (BITS - 1):
        raise ValueError("too many distinct ids for the table")
    c = counts[seen]
    freq = 1 + np.floor(c * (((1 << BITS) - len(seen)) / c.sum())).astype(np.int64)
    freq[np.argmax(freq)] += (1 << BITS) - freq.sum()
    return seen, freq


def _shape(n: int) -> tuple[int, int]:
    """Blocks, and steps of the last block."""
    blocks = -(-n // (LANES * STEPS))
    return blocks, -(-(n - (blocks - 1) * LANES * STEPS) // LANES) if n else 0


def encode_segment(ids: np.ndarray) -> bytes:
    n = len(ids)
    seen, freq = _table(ids) if n else (np.empty(0, np.int64), np.empty(0, np.int64))
    blocks, last = _shape(n)
    head = np.array([n, len(seen), blocks], np.uint32)
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    rank[seen] = np.arange(len(seen))
    sym = np.zeros(blocks * LANES * STEPS, np.int64)
    if n:
        sym[:] = np.argmax(freq)
        sym[:n] = rank[ids]
    grid = np.ascontiguousarray(sym.reshape(blocks, STEPS, LANES).transpose(1, 0, 2))
    f, start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((STEPS, blocks, LANES), np.uint32)
    sent = np.zeros((STEPS, blocks, LANES), bool)
    for t in range((STEPS if blocks > 1 else last) - 1, -1, -1):
        b = blocks if t < last else blocks - 1
        s = grid[t, :b]
        fs, y = f[s], x[:b]
        full = (y >> np.uint64(63 - BITS)) >= fs
        sent[t, :b] = full
        words[t, :b] = y  # the low 32 bits; those of lanes that aren't full are left out below
        y = y >> (full.astype(np.uint64) << np.uint64(5))
        q = y // fs
        x[:b] = (q << np.uint64(BITS)) + (y - q * fs) + start[s]
    order = sent.transpose(1, 0, 2)
    stream = words.transpose(1, 0, 2)[order]
    first = np.cumsum(np.append(0, order.reshape(blocks, -1).sum(1)))[:-1] if blocks else np.empty(0)
    crc = [zlib.crc32(ids[b * LANES * STEPS : (b + 1) * LANES * STEPS].astype("<u4").tobytes()) for b in range(blocks)]
    marks = np.zeros(blocks, [("x", "<u8", LANES), ("first", "<u4"), ("crc", "<u4")])
    marks["x"], marks["first"], marks["crc"] = x, first, crc
    body = MAGIC + np.append(head, len(stream)).astype("<u4").tobytes() + np.stack([seen, freq], 1).astype("<u4").tobytes() + marks.tobytes() + stream.astype("<u4").tobytes()
    return body + zlib.crc32(body).to_bytes(4, "little")


def decode_segment(data: bytes, only: int | None = None) -> np.ndarray:
    """Ids of a segment, or of one block of it. Raises if a checksum is wrong."""
    if data[:4] != MAGIC or only is None and zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a segment, or a damaged one")
    n, distinct, blocks, _ = np.frombuffer(data, "<u4", 4, 4).tolist()
    table = np.frombuffer(data, "<u4", 2 * distinct, 20).reshape(-1, 2)
    kind = np.dtype([("x", "<u8", LANES), ("first", "<u4"), ("crc", "<u4")])
    marks = np.frombuffer(data, kind, blocks, 20 + 8 * distinct)
    stream = np.frombuffer(data[20 + 8 * distinct + kind.itemsize * blocks : -4], "<u4")
    if not n:
        return np.empty(0, np.uint32)
    freq = table[:, 1].astype(np.int64)
    # Per slot: its symbol, the symbol's frequency, and the slot's place in the symbol's range.
    slot = np.repeat(np.arange(distinct, dtype=np.uint32), freq)
    f = np.repeat(freq.astype(np.uint32), freq)
    inner = (np.arange(1 << BITS) - np.repeat(np.cumsum(freq) - freq, freq)).astype(np.uint32)
    all_blocks, last = _shape(n)
    picked = np.arange(blocks) if only is None else np.array([only])
    x = marks["x"][picked].copy()
    at = marks["first"][picked].astype(np.int64)
    out = np.zeros((STEPS, len(picked), LANES), np.uint32)
    stream = np.append(stream, np.uint32(0)).astype(np.uint64)
    ends_short = picked[-1] == all_blocks - 1
    low = np.uint64((1 << BITS) - 1)
    for t in range(STEPS if len(picked) > 1 or not ends_short else last):
        b = len(picked) - (1 if ends_short and t >= last else 0)
        y = x[:b]
        r = (y & low).astype(np.int64)
        out[t, :b] = slot[r]
        y = f[r] * (y >> np.uint64(BITS)) + inner[r]
        need = y < LOW
        place = np.cumsum(need, axis=1, dtype=np.int32)
        got = stream[np.minimum(at[:b, None] + place - need, len(stream) - 1)]
        x[:b] = np.where(need, (y << np.uint64(32)) | got, y)
        at[:b] += place[:, -1]
    ids = table[:, 0].astype(np.uint32)[out.transpose(1, 0, 2).reshape(len(picked), -1)]
    size = LANES * STEPS
    for row, b in zip(ids, picked):
        if zlib.crc32(row[: min(size, n - b * size)].astype("<u4").tobytes()) != marks["crc"][b]:
            raise ValueError(f"block {b} is damaged")
    return ids.reshape(-1)[: n if only is None else min(size, n - only * size)]


_SEGMENT = "part int, seg int, ids long, doc_ids array<long>, lengths array<int>, data binary"


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg = encoder(path), TaskContext.get().partitionId(), 0
        docs: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seg, docs, ids, sizes
            every, n = np.concatenate(ids), np.concatenate(sizes)
            row = [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(every)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32())), pa.array([encode_segment(every)], pa.binary())]
            seg, docs, ids, sizes = seg + 1, [], [], []
            return pa.RecordBatch.from_arrays(row, ["part", "seg", "ids", "doc_ids", "lengths", "data"])

        for batch in batches:
            texts, of = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b] or "") < 2_000_000):
                    size += len(texts[b] or "")
                    b += 1
                got, n = enc([t or "" for t in texts[a:b]])
                docs += of[a:b]
                ids.append(got)
                sizes.append(n)
                a = b
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Segments of all documents in ascending doc_id order (part, then seg); written and read back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return common.materialise(rows.mapInArrow(_write(tokenizer), _SEGMENT), "token-ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = decode_segment(batch.column("data")[i].as_py()).astype("<u4")
            n = batch.column("lengths")[i].values.to_numpy()
            at = np.append(0, np.cumsum(n, dtype=np.int64))
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[i].as_py()] * len(n), pa.int32()) for c in ("part", "seg")] + [batch.column("doc_ids")[i].values, pa.array(at[:-1]), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_ids(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = segments.select("part", "seg", "doc_ids", "lengths", "data").mapInArrow(_read, "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    of_part = segments.groupBy("part").agg(F.sum("ids").alias("n"))
    before = of_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = segments.select("part", "seg", F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("seg_start"))
    starts = inside.join(before.hint("merge"), "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("first"))
    return rows.join(starts.hint("merge"), ["part", "seg"]).select("doc_id", (F.col("first") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


QUERIES = {"op6_token_ids": op6_token_ids}
ORACLES = {}
