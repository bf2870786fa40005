"""Language ID by prediction by partial matching (PPM).

For each language a context tree over bytes: contexts of 0 to ORDER bytes with the counts of the bytes that followed them. A byte's
code length under a language comes from the longest context seen there: c / (n + d) if the byte followed it (c of n times, among
d different bytes), else the escape d / (n + d) and the next shorter context, without the bytes that the longer one already
excluded, down to equal shares of all bytes left. So the probabilities of the bytes behind any context sum to one, and the sum over a text is
its exact code length under the frozen counts. The shortest code wins; the score is that language's posterior under equal priors.

Trees are fitted on at most TRAIN_DOCS documents a language, of at most TRAIN_BYTES bytes each, the first in a seeded order of those
outside the held-out fold: a documented bound (2 MB of text a language), which makes a tree at most some MB. Contexts of three bytes and
more that were seen less than MIN_SEEN times are left out. Every text is coded whole. Texts begin with ORDER bytes 0xFF,
which UTF-8 never has.

Nulls: a null text is `und`, as is one without a letter; a null lang doesn't train, nor does a null doc_id, which isn't held out. Without
any tree all is `und`. Very long texts are coded whole, one at a time. Ties go to the language that is first by name. Repeated rows
are predicted each. Empty table: an empty result. Other columns aren't read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .wordhash import chunks

ORDER = 5
TRAIN_DOCS, TRAIN_BYTES, MIN_SEEN = 200, 10_000, 2
FOLDS, HELD_OUT = 3, 1
SEED = 12
UNKNOWN = "und"
U = np.uint64
PAD = b"\xff" * ORDER
#: Windows whose code lengths are kept from chunk to chunk.
CACHE = 1_000_000


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of every byte: the ORDER bytes before it, the nearest in the highest place, and the byte in the lowest."""
    data = np.frombuffer(b"".join([PAD + t for t in texts]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) + (text + 1) * ORDER
    w = data[at].astype(U)
    for k in range(1, ORDER + 1):
        w |= data[at - k].astype(U) << U(8 * (ORDER - k + 1))
    return text, w


def _place(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in a sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


class Tree:
    """Per order: contexts with their totals, and totals of the next shorter context without their bytes; (context, byte) with counts."""

    def __init__(self, orders: list[dict[str, np.ndarray]]) -> None:
        self.orders = orders

    @classmethod
    def fit(cls, texts: list[bytes]) -> Tree:
        w = np.sort(windows(texts)[1])
        orders: list[dict[str, np.ndarray]] = []
        for k in range(ORDER + 1):
            key = (w >> U(8 * (ORDER - k + 1))) << U(8) | w & U(255)
            entry, count = np.unique(key, return_counts=True)
            first = np.flatnonzero(np.diff(entry >> U(8), prepend=U(1 << 63)))
            total = np.add.reduceat(count, first) if len(first) else first
            distinct = np.diff(np.append(first, len(entry)))
            if k > 2:
                often = total >= MIN_SEEN
                stay = np.repeat(often, distinct)
                entry, count, total, distinct = entry[stay], count[stay], total[often], distinct[often]
                first = np.cumsum(distinct) - distinct
            node = entry[first] >> U(8)
            left, rest = np.zeros(len(node), np.int64), 256 - distinct
            if k and len(node):
                below = orders[-1]
                at, _ = _place(below["node"], node >> U(8))
                # The shorter context has seen every byte that this one has.
                same, _ = _place(below["entry"], (entry >> U(16)) << U(8) | entry & U(255))
                left = below["total"][at] - np.add.reduceat(below["count"][same], first)
                rest = below["distinct"][at] - distinct
            orders.append({"node": node, "total": total, "distinct": distinct, "left": left, "rest": rest, "entry": entry, "count": count})
        return cls(orders)

    def code_lengths(self, w: np.ndarray) -> np.ndarray:
        """Bits of the byte of each window behind its context; w sorted is fastest."""
        bits = np.zeros(len(w))
        open_ = np.arange(len(w))
        seen = np.zeros(len(w), bool)
        n, d = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for k in range(ORDER, -1, -1):
            o = self.orders[k]
            x = w[open_]
            context = x >> U(8 * (ORDER - k + 1))
            at, there = _place(o["node"], context)
            new = there & ~seen
            if new.any():
                n[new], d[new] = o["total"][at[new]], o["distinct"][at[new]]
            seen |= there
            entry, hit = _place(o["entry"], context << U(8) | x & U(255))
            bits[open_[hit]] += np.log2((n[hit] + d[hit]) / o["count"][entry[hit]])
            go = ~hit
            escape = go & there & (d > 0)
            bits[open_[escape]] += np.log2((n[escape] + d[escape]) / d[escape])
            n = np.where(there, o["left"][at] if len(o["left"]) else 0, n)[go]
            d = np.where(there, o["rest"][at] if len(o["rest"]) else 0, d)[go]
            open_, seen = open_[go], seen[go]
            if not len(open_):
                return bits
        bits[open_] += np.log2(np.where(seen, d, 256))
        return bits

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{f"{name}{k}": v for k, o in enumerate(self.orders) for name, v in o.items()})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            names = ("node", "total", "distinct", "left", "rest", "entry", "count")
            return cls([{name: z[f"{name}{k}"] for name in names} for k in range(ORDER + 1)])


class Models:
    """The trees of all languages; code lengths of windows met before are kept."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]
        self.known, self.bits = np.empty(0, U), np.empty((0, len(self.langs)))

    def lookup(self, w: np.ndarray) -> np.ndarray:
        """Code lengths of sorted, distinct windows."""
        at, there = _place(self.known, w)
        out = np.empty((len(w), len(self.langs)))
        out[there] = self.bits[at[there]]
        new = w[~there]
        if len(new):
            fresh = np.stack([t.code_lengths(new) for t in self.trees], axis=1)
            out[~there] = fresh
            if len(self.known) + len(new) <= CACHE:
                into = np.searchsorted(self.known, new)
                self.known, self.bits = np.insert(self.known, into, new), np.insert(self.bits, into, fresh, axis=0)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        text, w = windows(texts)
        distinct, of = np.unique(w, return_inverse=True)
        bits = self.lookup(distinct)
        return np.stack([np.bincount(text, weights=bits[of, i], minlength=len(texts)) for i in range(len(self.langs))], axis=1)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        odds = np.exp2(bits[np.arange(len(texts)), best][:, None] - bits).sum(axis=1)
        return [self.langs[i] for i in best], 1 / odds


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": [key[0]], "tree": [Tree.fit([t.encode() for t in rows["text"]]).save()]})


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, limit: int = TRAIN_DOCS, most: int = TRAIN_BYTES, seed: int = SEED) -> dict[str, bytes]:
    """docs(doc_id, lang, text) -> a tree for each language, of at most `limit` texts of at most `most` bytes outside the held-out fold."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & (_fold(F.col("doc_id")) != HELD_OUT)).withColumn("o", common.seeded_key(seed, F.col("doc_id")))
    # A language's share of rows that are looked at, so that few rows meet in the window: about four times the limit.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return {}
    rates = spark.createDataFrame([(r.lang, int(min(1.0, 4 * limit / r.n) * (1 << 60))) for r in sizes], "lang string, below long")
    some = known.join(F.broadcast(rates), "lang").filter((F.col("o") < F.col("below")) & F.octet_length("text").between(1, most))
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", F.xxhash64("text")))).filter(F.col("r") <= limit)
    return {r.lang: r.tree for r in first.groupBy("lang").applyInPandas(_fit, "lang string, tree binary").collect()}


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models({k: Tree.load(v) for k, v in shared.value.items()})
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                if models.langs:
                    lang, score = models.predict(texts)
                else:
                    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                letters = batch.column("letters").slice(a, b - a).to_pylist()
                lang = [x if y else UNKNOWN for x, y in zip(lang, letters)]
                score = np.where([x == UNKNOWN and not y for x, y in zip(lang, letters)], 0.0, score)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, trees: dict[str, bytes]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    # A text without a letter needs no code.
    rows = docs.select("doc_id", F.when(letters, text).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op12_language_id": op12_language_id}
ORACLES = {}
