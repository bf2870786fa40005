"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask of a few out of at most twelve consecutive words; the other positions are ignored, so a substitution
there doesn't hide the overlap. Seed hashes of benchmark items and of documents are joined, and around each hit the aligned
words are compared. An item is in a document if WINDOW aligned words (without insertions) agree in all but four; an item of
fewer words must occur whole, with a substitution for each full five words at most. Items of fewer than five words thus must
occur exactly. The masks of each length find all such occurrences (tests/llm proves it by enumeration). Documents are only
searched by masks of which the benchmark has items. A match of fewer than five words says too little to lose a document for:
overlaps() reports it, decontaminate() acts on items of min_words or more.

Documents are read once: a Bloom filter of the benchmark's seeds (8 MB, whatever the benchmark's size) discards positions
that can't join, and what joins carries the words around it. The join itself is a shuffled one, so the benchmark may be
large. A seed repeated from word to word is one row with a count, and only the words aligned with an item go to the verification.

Nulls: null texts have no words; null ids are kept as such. Very long texts are searched whole. Ties: all windows of an item
in a document are one overlap, from the first to the last. Repeated rows are reported once. Empty tables on either side: no
hits. Extra columns are ignored, and kept by decontaminate(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import _bitmap, _has
from .wordhash import Texts, U, chunks, mix, ragged

WINDOW = 20
#: Words for each of which one may differ.
SHARE = 5
#: Fewest words of an item -> the masks (positions they read) of items of so many words and more.
ITEM_MASKS = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2), (0, 1, 3)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    10: ((0, 2, 3, 4, 7), (0, 3, 5, 6, 7), (0, 1, 4, 6, 7)),
    15: ((0, 1, 2, 5, 7, 10), (0, 2, 3, 6, 7, 8), (0, 1, 3, 7, 9, 10)),
    WINDOW: ((0, 1, 4, 6, 8, 9), (0, 1, 3, 9, 10, 11), (0, 1, 3, 4, 5, 6)),
}
MIN_WORDS = 5
BLOOM_BITS = 1 << 26


def substitutions(n: int) -> int:
    """Words that may differ in a window of an item of n words."""
    return min(n, WINDOW) // SHARE


def _seeds(x: Texts, masks: tuple[tuple[int, ...], ...], first_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the first word, hash) for each mask at every position where it lies in one text."""
    for k, mask in enumerate(masks, first_id):
        m = len(x.word) - mask[-1]
        if m <= 0:
            continue
        at = np.flatnonzero(x.doc[:m] == x.doc[mask[-1] :])
        h = np.full(len(at), k + 1, U)
        for i, p in enumerate(mask):
            h = (h + x.word[at + p]) * U(0xD6E8FEB86659FD93) + U(2 * i + 1)
        yield at, mix(h)


def _families() -> dict[int, tuple[int, tuple[tuple[int, ...], ...]]]:
    """Fewest words -> number of the first mask, masks."""
    out, first_id = {}, 0
    for low, masks in ITEM_MASKS.items():
        out[low] = first_id, masks
        first_id += len(masks)
    return out


def _family(n: np.ndarray) -> np.ndarray:
    """The fewest words of the masks of items of n words; 0 for items that aren't searched."""
    lows = np.array([0, *ITEM_MASKS])
    return lows[np.searchsorted(lows, n, "right") - 1]


def _counted(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and counts of runs of one hash at consecutive positions."""
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | np.append(True, h[1:] != h[:-1])[: len(h)])
    return at[new], h[new], np.diff(np.append(new, len(at)))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, the family of its masks, its word hashes, and its seeds (hash, position, count)."""
    for batch in batches:
        for a, b, texts in chunks(batch.column("text")):
            x = Texts(texts, fold=True)
            n = x.words[x.doc]
            found = []
            for low, (first_id, masks) in _families().items():
                for at, h in _seeds(x, masks, first_id):
                    on = _family(n[at]) == low
                    if not substitutions(low):
                        on &= at == x.word_at[x.doc[at]]
                    found.append(_counted(at[on], h[on].view(np.int64)))
            at, h, count = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (zip(*found) if found else ((), (), ())))
            order = np.argsort(at, kind="stable")
            at, h, count = at[order], h[order], count[order]
            off = np.searchsorted(x.doc[at], np.arange(x.n + 1)) if len(at) else np.zeros(x.n + 1, np.int64)
            words = np.append(x.word_at, len(x.word))
            cols = [batch.column("item_id").slice(a, b - a), pa.array(_family(x.words), pa.int32()), ragged(x.word.view(np.int64), words, pa.int64())]
            cols += [ragged(h, off, pa.int64()), ragged(at - x.word_at[x.doc[at]], off, pa.int32()), ragged(count, off, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "family", "words", "seed", "place", "count"])


def _second(h: np.ndarray) -> np.ndarray:
    return h >> np.int64(27)


def _hits(bloom, used: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of positions whose seeds may be the benchmark's, with all words a window through them can reach."""
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                x = Texts(texts, fold=True)
                found = []
                for at, h in (y for low, (k, masks) in _families().items() if low in used for y in _seeds(x, masks, k)):
                    s = h.view(np.int64)
                    on = _has(bloom.value, s, BLOOM_BITS)
                    on[on] = _has(bloom.value, _second(s[on]), BLOOM_BITS)
                    found.append(_counted(at[on], s[on]))
                if not found or not sum(len(p) for p, *_ in found):
                    continue
                at, s, count = (np.concatenate(v) for v in zip(*found))
                order = np.argsort(at, kind="stable")
                at, s, count = at[order], s[order], count[order]
                last = np.maximum.accumulate(at + count - 1)
                new = np.flatnonzero((at - np.append(-(10**9), last[:-1]) > 2 * WINDOW) | (np.diff(x.doc[at], prepend=-1) != 0))
                ends = np.append(new[1:], len(at))
                d = x.doc[at[new]]
                lo = np.maximum(at[new] - WINDOW, x.word_at[d])
                hi = np.minimum(last[ends - 1] + 2 * WINDOW, x.word_at[d] + x.words[d])
                off = np.concatenate([[0], np.cumsum(hi - lo)])
                idx = np.repeat(lo - off[:-1], hi - lo) + np.arange(off[-1])
                take = pa.array(d)
                cols = [batch.column(c).slice(a, b - a).take(take) for c in ("doc_id", "th")]
                cols += [pa.array((lo - x.word_at[d]).astype(np.int64)), ragged(x.word[idx].view(np.int64), off, pa.int64())]
                parts = np.append(new, len(at))
                cols += [ragged(s, parts, pa.int64()), ragged(at - np.repeat(lo, ends - new), parts, pa.int32()), ragged(count, parts, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "first", "around", "seed", "place", "count"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, item_id, start, end, matches): the words of the document that verified windows cover, ends exclusive."""
    for batch in batches:
        around, words = batch.column("around"), batch.column("words")
        diag, first = batch.column("diag").to_numpy(), batch.column("first").to_numpy()
        on, start, end, matches = [], [], [], []
        for i in range(batch.num_rows):
            d, t = around[i].values.to_numpy(), words[i].values.to_numpy()
            k = int(diag[i])
            lo, hi = max(0, -k), min(len(t), len(d) - k)
            size = min(WINDOW, len(t))
            if hi - lo < size:
                continue
            sums = np.concatenate([[0], np.cumsum(t[lo:hi] == d[lo + k : hi + k])])
            got = sums[size:] - sums[:-size]
            good = np.flatnonzero(got >= size - substitutions(size))
            if len(good):
                on.append(i)
                start.append(first[i] + lo + k + good[0])
                end.append(first[i] + lo + k + good[-1] + size)
                matches.append(int(sums[good[-1] + size] - sums[good[0]]))
        keep = pa.array(on, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("doc_id", "th", "item_id")] + [pa.array(v, pa.int64()) for v in (start, end, matches)], ["doc_id", "th", "item_id", "start", "end", "matches"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> verified overlaps: doc_id, th (xxhash64 of the text), item_id, start, end, matches."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(_items, "item_id long, family int, words array<long>, seed array<long>, place array<int>, count array<int>")
    items = common.materialise(items.withColumn("item", F.monotonically_increasing_id()), "seed-items")
    each = F.explode(F.arrays_zip("seed", "place", "count")).alias("s")
    seeds = items.select("item", F.size("words").alias("n"), each).select(F.col("s.seed").alias("seed"), "item", "n", F.col("s.place").alias("item_place"), F.col("s.count").alias("item_count"))
    seeds = common.materialise(seeds, "seed-hashes")
    both = seeds.select(F.explode(F.array("seed", F.shiftright("seed", 27))).alias("h"))
    bloom = spark.sparkContext.broadcast(_bitmap(both, F.col("h"), BLOOM_BITS))
    used = [r.family for r in items.select("family").distinct().collect()]  # at most as many as there are families
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    runs = docs.mapInArrow(_hits(bloom, used), "doc_id long, th long, first long, around array<long>, seed array<long>, place array<int>, count array<int>")
    runs = common.materialise(runs.withColumn("run", F.monotonically_increasing_id()), "seed-runs")
    hits = runs.select("run", each).select("run", F.col("s.seed").alias("seed"), F.col("s.place").alias("place"), F.col("s.count").alias("count"))
    # A seed that repeats in both gives each alignment of the two runs once.
    low = F.col("place") - F.col("item_place") - F.col("item_count") + 1
    high = F.col("place") + F.col("count") - 1 - F.col("item_place")
    hits = hits.join(seeds.hint("merge"), "seed").select("run", "item", "n", F.explode(F.sequence(low, high)).alias("diag")).distinct()
    # Of the words around, those aligned with the item; what lies before them is added to `first`.
    cut = F.greatest("diag", F.lit(0))
    full = hits.join(runs.select("run", "doc_id", "th", "first", "around").hint("merge"), "run")
    full = full.select("item", "doc_id", "th", (F.col("first") + cut).alias("first"), F.slice("around", cut + 1, F.col("n") + F.least("diag", F.lit(0))).alias("around"), F.least("diag", F.lit(0)).alias("diag"))
    full = full.join(items.select("item", "item_id", "words").hint("merge"), "item")
    full = full.select("doc_id", "th", "item_id", "first", "around", "words", "diag")
    found = full.mapInArrow(_verify, "doc_id long, th long, item_id long, start long, end long, matches long")
    return found.groupBy("doc_id", "th", "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("matches").alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the documents that hold a benchmark item of min_words or more; all columns kept."""
    d, t, th = common.fresh(docs, "d", "t", "th")
    items = benchmark.filter(common.word_count(F.col("text").cast("string")) >= min_words)
    bad = common.materialise(overlaps(docs, items).select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct(), "seed-bad")
    keyed = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(bad.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), "left_anti").drop(th)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "matches")


_FOLDED = "[translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])]"
#: All alignments of items and documents that share enough words, and all windows of each.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, sha256(text) AS sha, {_FOLDED} AS w FROM documents), i AS (SELECT row_number() OVER () AS k, item_id, {_FOLDED} AS w FROM benchmark),
dw AS (SELECT r, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d), iw AS (SELECT k, len(w) AS n, least(len(w), {WINDOW}) AS size, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM i),
c AS (SELECT r, k, p - q AS diag, any_value(m) AS m, any_value(n) AS n, any_value(size) AS size, list(q) AS qs FROM dw JOIN iw USING (word) GROUP BY r, k, p - q HAVING count(*) >= any_value(size) - any_value(size) // {SHARE}),
s AS (SELECT *, unnest(generate_series(greatest(0, -diag), least(n, m - diag) - size)) AS place FROM c),
g AS (SELECT r, k, diag, any_value(size) AS size, any_value(qs) AS qs, min(place) AS low, max(place) AS high FROM s WHERE len([q for q in qs if q >= place AND q < place + size]) >= size - size // {SHARE} GROUP BY r, k, diag)
SELECT doc_id, item_id, min(diag + low) AS start_word, max(diag + high + size) AS end_word, max(len([q for q in qs if q >= low AND q < high + size])) AS matches FROM g JOIN d USING (r) JOIN i USING (k) GROUP BY doc_id, sha, item_id"""
QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES = {"op2_decontaminate": SQL}
