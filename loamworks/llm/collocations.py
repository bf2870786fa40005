"""Phrase collocations by direct-address tiling.

Words get ids by falling frequency; the plane of id pairs is cut into tiles of SIDE x SIDE. Each task gathers the pairs of
neighbouring ids of its texts and counts a tile that has many of them in a dense array (bincount by place in the tile), and the
rest as sorted coordinates. The partial counts are summed by pair. Pairs that are frequent enough are ranked again and are
the units of the next round: a phrase of k words is a pair of neighbouring phrases of k - 1 words that share all but one.

Ids are given to the HEAD most frequent units at most (16 MB, broadcast). Units behind them take part under their 63-bit hash,
always as sorted coordinates; a bitmap of fixed size (16 MB) leaves out the words that can't be among them. So the bound decides how
a pair is counted, never whether. Identity is by hash: 63 bits for language and phrase.

A phrase's score is floor(10**6 * a * a / (l * r)) at its worst cut (a, l, r: occurrences of the phrase and of the two parts),
in decimals of 38 digits. A phrase goes if a longer one that contains it occurs at least SHARE percent as often.

Nulls: a null text is empty, a null language is `und`; a null doc_id is as any other. Empty texts have no words. Very long texts are
handled whole, one at a time. Ties go to the shorter first part, then by count, then by phrase (UTF-8 bytes). Repeated rows
count each. Empty table: an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .ngram_join import _bitmap, _has
from .wordhash import _FOLDED, U, _sums, chunks, mix, powers

MIN_COUNT, MAX_WORDS, SHARE, TOP = 10, 3, 50, 2000
HEAD = 1 << 20
TAIL_BITS = 1 << 27
#: Side of a tile; a tile with a pair for every DENSE cells is counted as a dense array.
SIDE_BITS, DENSE = 9, 8
#: Pairs a task holds before it counts them.
BUFFER = 1_500_000
SALTS = 64
_LEFT, _RIGHT, _SIGN = U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7), U(1 << 63)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a chunk of texts: start and end in `data`, doc, number of the piece, and hash with the language."""

    def __init__(self, texts: list[bytes], lang: np.ndarray) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[self.data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        lengths = self.end - self.start
        at = np.flatnonzero(inside)
        place = at - np.repeat(self.start, lengths)
        raw = _sums(_FOLDED[self.data[at]] * powers(int(lengths.max(initial=0)) + 1)[place], self.start, lengths)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc = np.searchsorted(np.cumsum(sizes + 1), self.start, "right")
        self.piece = np.cumsum(kind == 2)[self.start] if len(edge) else np.empty(0, np.int64)
        self.word = (mix(mix(raw + lengths.astype(U)) ^ lang.view(U)[self.doc]) | _SIGN).view(np.int64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only those that lie in one piece mean anything."""
        h = self.word
        for _ in range(k - 1):
            h = joined(h[:-1], h[1:])
        return h

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one piece."""
        n = max(len(self.word) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (mix(left.view(U) * _LEFT + right.view(U) * _RIGHT) | _SIGN).view(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, h, n) of each chunk, and a row without word for all words of a language."""
    for batch in batches:
        lh, langs = batch.column("lh").to_numpy(), batch.column("lang")
        for a, b, texts in chunks(batch.column("text")):
            x = Words(texts, lh[a:b])
            h, first, n = np.unique(x.word, return_index=True, return_counts=True)
            data = _LOWER[x.data].tobytes()
            words = [data[i:j] for i, j in zip(x.start[first].tolist(), x.end[first].tolist())]
            some, at, of = np.unique(lh[a:b][x.doc], return_index=True, return_inverse=True)
            total = np.bincount(of, minlength=len(some))
            cols = [langs.take(pa.array(a + x.doc[np.concatenate([first, at])])), pa.array(words + [None] * len(some), pa.binary()).cast(pa.string()), pa.array(np.concatenate([h, np.zeros(len(some), np.int64)])), pa.array(np.concatenate([n, total]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "h", "n"])


class Units:
    """What pairs are made of: the frequent ones by rank, the others by hash if the bitmap has them."""

    def __init__(self, h: np.ndarray, f: np.ndarray, tail: np.ndarray | None) -> None:
        self.by_rank = h[np.lexsort((h, -f))]
        self.rank = np.argsort(self.by_rank)
        self.h = self.by_rank[self.rank]
        self.tail = tail

    def codes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, or the hash, which is negative; whether it may be a unit at all)."""
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            known = self.h[at] == h
            code = np.where(known, self.rank[at], h)
        else:
            known, code = np.zeros(len(h), bool), h
        if self.tail is not None:
            rest = np.flatnonzero(~known)
            known[rest] = _has(self.tail, h[rest], TAIL_BITS)
        return code, known

    def hashes(self, code: np.ndarray) -> np.ndarray:
        out = code.copy()
        ranked = code >= 0
        out[ranked] = self.by_rank[code[ranked]]
        return out


def units(df: DataFrame, head: int = HEAD) -> Units:
    """df(h, f) -> units; the ranked ones are those of the highest powers of two of f that are `head` at most in all."""
    sizes = {r.e: r.n for r in df.groupBy(F.length(F.bin("f")).alias("e")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    low, n = 64, 0
    while low > 1 and n + sizes.get(low - 1, 0) <= head:
        low -= 1
        n += sizes.get(low, 0)
    top = F.length(F.bin("f")) >= low
    ranked = df.filter(top).select("h", "f").toArrow()
    tail = _bitmap(df.filter(~top), F.col("h"), TAIL_BITS) if n < sum(sizes.values()) else None
    return Units(ranked.column("h").to_numpy(), ranked.column("f").to_numpy(), tail)


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of codes and how often each occurs."""
    ranked = (left >= 0) & (right >= 0)
    found = []
    if not ranked.all():
        l, r = left[~ranked], right[~ranked]
        order = np.lexsort((r, l))
        l, r = l[order], r[order]
        new = np.flatnonzero(np.append(True, (l[1:] != l[:-1]) | (r[1:] != r[:-1])))
        found.append((l[new], r[new], np.diff(np.append(new, len(l)))))
    key = left[ranked] << 31 | right[ranked]
    tile = left[ranked] >> SIDE_BITS << 31 | right[ranked] >> SIDE_BITS
    names, of, held = np.unique(tile, return_inverse=True, return_counts=True)
    dense = held * DENSE >= 1 << 2 * SIDE_BITS
    side = (1 << SIDE_BITS) - 1
    if dense.any():
        into = np.cumsum(dense) - 1
        pick = dense[of]
        mine, cell = into[of[pick]], (key[pick] >> 31 & side) << SIDE_BITS | key[pick] & side
        order = np.argsort(mine, kind="stable")
        cell, ends = cell[order], np.cumsum(np.bincount(mine, minlength=dense.sum()))
        for name, a, b in zip(names[dense].tolist(), np.append(0, ends), ends):
            n = np.bincount(cell[a:b], minlength=1 << 2 * SIDE_BITS)
            at = np.flatnonzero(n)
            found.append(((name >> 31 << SIDE_BITS) + (at >> SIDE_BITS), ((name & (1 << 31) - 1) << SIDE_BITS) + (at & side), n[at]))
        key = key[~pick]
    sparse, n = np.unique(key, return_counts=True)
    found.append((sparse >> 31, sparse & (1 << 31) - 1, n))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def _pairs(shared, k: int):
    """Counts of pairs of neighbouring (k - 1)-grams, as codes, of each BUFFER of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: Units = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            cols = count_pairs(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["k1", "k2", "n"])

        for batch in batches:
            lh = batch.column("lh").to_numpy()
            for a, b, texts in chunks(batch.column("text")):
                x = Words(texts, lh[a:b])
                code, known = u.codes(x.grams(k - 1))
                at = np.flatnonzero(x.within(k) & known[:-1] & known[1:])
                if len(at):
                    held.append((code[at], code[at + 1]))
                if sum(len(x) for x, _ in held) >= BUFFER:
                    yield counted()
        if held:
            yield counted()

    return run


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: Units = shared.value
        for batch in batches:
            left, right = (u.hashes(batch.column(c).to_numpy()) for c in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(joined(left, right)), batch.column("f")], ["u1", "u2", "h", "f"])

    return run


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """docs(lang, lh, text) -> (lang, word, h, f) of the words with f >= min_count; rows without word have the sum of a language."""
    n = docs.mapInArrow(_count_words, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("f"))
    return common.materialise(n.filter((F.col("f") >= min_count) | F.col("word").isNull()), "phrases-words")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, share: int = SHARE, top: int = TOP, head: int = HEAD) -> DataFrame:
    """docs(lang, text) -> the first `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lh"), F.col("text").cast("string").alias("text"))
    words = vocabulary(docs, min_count)
    # Of each phrase: how often its first 1, 2 ... words occur (pre), and its last (suf).
    level = words.filter("word IS NOT NULL").select("h", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("pre"), F.array("f").alias("suf"))
    written, found = [words], []
    for k in range(2, max_words + 1):
        shared = spark.sparkContext.broadcast(units(level, head))
        pairs = docs.select("lh", "text").mapInArrow(_pairs(shared, k), "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
        pairs = common.materialise(pairs.mapInArrow(_decoded(shared), "u1 long, u2 long, h long, f long"), "phrases-pairs")
        left = level.select(F.col("h").alias("u1"), "lang", F.col("phrase").alias("_head"), "pre")
        right = level.select(F.col("h").alias("u2"), F.col("last").alias("_last"), "suf")
        both = pairs.join(left.hint("merge"), "u1").join(right.hint("merge"), "u2")
        made = both.select("h", "f", "lang", F.concat_ws(" ", "_head", "_last").alias("phrase"), F.col("_last").alias("last"), F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"), "u1", "u2")
        if found:
            # A longer phrase that contains one of k - 1 words contains it at its begin or its end, or holds one of k words that does.
            cover = made.select(F.explode(F.array("u1", "u2")).alias("h"), "f").groupBy("h").agg(F.max("f").alias("_over"))
            found[-1] = found[-1].join(cover.hint("merge"), "h", "left").filter(F.coalesce(100 * F.col("_over") < share * F.col("a"), F.lit(True)))
        made = common.materialise(made, "phrases-level")
        written += [pairs, made]
        level = made
        found.append(made.select("h", "lang", "phrase", F.col("f").alias("a"), _worst_cut(k).alias("c")))
    every = found[0]
    for x in found[1:]:
        every = every.select("lang", "phrase", "a", "c").unionByName(x.select("lang", "phrase", "a", "c"))
    every = every.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    # The first of each of SALTS parts of a language, then the first of those.
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    every = every.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*by))).filter(F.col("_r") <= top)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
    n = words.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    out = common.materialise(every.join(n.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases-top")
    common.release(*written)
    return out


def _worst_cut(k: int):
    """The cut with the lowest score; of equal ones that with the shortest first part."""
    a, wide = F.col("f"), "decimal(20,0)"
    cuts = []
    for j in range(1, k):
        l, r = F.col("pre")[j - 1], F.col("suf")[k - j - 1]
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a.cast(wide) * a.cast(wide)), l.cast(wide) * r.cast(wide)).cast("long")
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {MIN_COUNT}),
parts AS (SELECT lang, k, phrase, a, j, array_to_string(w[1 : j], ' ') AS p, array_to_string(w[j + 1 : k], ' ') AS q FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
cut AS (SELECT parts.*, x.a AS l, y.a AS r, (1000000::HUGEINT * parts.a * parts.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = p JOIN f y ON y.lang = parts.lang AND y.phrase = q),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, phrase, max(a) AS over_ FROM (SELECT lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN inner_ ON worst.k = 2 AND inner_.lang = worst.lang AND inner_.phrase = worst.phrase WHERE over_ IS NULL OR 100 * over_ < {SHARE} * worst.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}"""
QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": SQL}
