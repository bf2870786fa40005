"""Quality rules: lines that too many documents of a host share are removed, and documents they leave depleted rejected.

Every line with a word is hashed in normal form (folded words, white space ignored). For each host (column `source`) a
line's distinct documents are counted: rows of different id or text, as the query does (by_row=True), or different texts, as the pipeline
does, where copies of one page are no reason to lose it. A line is above the limit when more than min_docs documents of its host hold
it (long_docs, if it has LONG_WORDS words or more). With small_share a small host has a limit too: more than two documents and
more than that share of all it has; the query has none. No limit grows beyond min_docs, so that a line is judged alike in a
large and in a huge host. Lines above it go from all documents. A document is depleted, and rejected, when fewer than min_left of its words
remain. Documents that fail the base rules (under 50 words, or over half of the words in repeated three-word windows) are
rejected too.

Nulls: a null text has no words (rejected: under 50 words), a null source is a host of its own, null ids are documents as
others. Very long texts are handled whole, one at a time. Ties don't occur: no line is spared. Repeated rows get the same
verdict each. Empty table: an empty result. Extra columns stay as they are in clean(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordhash import Texts, chunks, per_doc, ragged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
SMALL_SHARE = 0.5
LONG_WORDS = 50
LONG_DOCS = 5
MIN_LEFT = 0.5
SYMBOLS = b"#*$%&|<>"
#: Rows up to which the lines above the limit are broadcast (24 bytes each); beyond, a shuffled join is used.
BROADCAST_LINES = 200_000
#: Small hosts up to which they are broadcast; beyond, lines and hosts meet in SALTS parts of each host.
BROADCAST_HOSTS, SALTS = 200_000, 32
_STATS = "doc_id long, source string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_no array<int>, line_words array<int>, line_hash array<long>"
_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True


def _covered(x: Texts) -> np.ndarray:
    """Per text: words that lie in a window of three words found twice or more in the text."""
    at, h = x.windows(3)
    doc = x.doc[at]
    order = np.lexsort((h, doc))
    same = np.zeros(len(at), bool)
    if len(at):
        pair = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        same[order[1:][pair]] = True
        same[order[:-1][pair]] = True
    hit = np.zeros(len(x.word) + 3, bool)
    for k in range(3):
        hit[at[same] + k] = True
    return np.bincount(x.doc[hit[: len(x.word)]], minlength=x.n)


def _count_by_doc(x: Texts, flag: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flag.astype(np.int64), x.first) if x.n else np.empty(0, np.int64)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for a, b, texts in chunks(text):
            exact, folded = Texts(texts, fold=False), Texts(texts, fold=True)
            doc, no, words, raw, _ = exact.lines()
            normal = folded.lines()[4]
            order = np.lexsort((no, raw, doc))
            dup = (doc[order][1:] == doc[order][:-1]) & (raw[order][1:] == raw[order][:-1])
            n_dup = np.bincount(doc[order][1:][dup], minlength=exact.n)
            inside = np.zeros(len(exact.data) + 1, np.int8)
            inside[exact.start], inside[exact.end] = 1, -1
            char = (np.cumsum(inside)[:-1] > 0) & ((exact.data & 0xC0) != 0x80)
            off = per_doc(doc, exact.n)
            cols = [batch.column(c).slice(a, b - a) for c in ("doc_id", "source", "th")]
            cols += [pa.array(v.astype(np.int64)) for v in (exact.words, _count_by_doc(exact, char), _count_by_doc(exact, _is_symbol[exact.data]), n_dup, _covered(exact))]
            # The lowest bit of a line's hash says whether the line is long.
            normal = (normal.view(np.int64) & ~np.int64(1)) | (words >= LONG_WORDS)
            cols += [ragged(no, off, pa.int32()), ragged(words, off, pa.int32()), ragged(normal, off, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_no", "line_words", "line_hash"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal doc_id, source and text get the same verdict, so these three say which it is."""
    return docs.withColumn("th", F.xxhash64("text"))


def _lines_above(stats: DataFrame, min_docs: int, small_share: float | None, long_docs: int, by_row: bool) -> DataFrame:
    """(source, line) of the lines above their limit."""
    each = ["source", "doc_id", "th"] if by_row else ["source", "th"]
    lines = stats.select(*each, F.explode(F.array_distinct("line_hash")).alias("line")).groupBy(*each, "line").agg(F.lit(1).alias("one"))
    counts = lines.groupBy("source", "line").agg(F.count("*").alias("n")).filter("n > 2")
    limit = F.when(F.col("line").bitwiseAND(1) == 1, F.lit(min(min_docs, long_docs))).otherwise(F.lit(min_docs))
    counts = common.materialise(counts.withColumn("above", F.col("n") > limit), "rules-counts")
    if small_share is None:
        return counts.filter("above").select("source", "line")
    # Only hosts of few documents have a limit of their own.
    hosts = stats.groupBy(*each).agg(F.lit(1).alias("one")).groupBy(F.col("source").alias("host")).agg(F.count("*").alias("docs"))
    hosts = common.materialise(hosts.filter(F.col("docs") * small_share < min_docs), "rules-hosts")
    few = hosts.count()
    rest = counts.filter(~F.col("above"))
    if not few:
        return counts.filter("above").select("source", "line")
    same = F.col("source").eqNullSafe(F.col("host"))
    if few <= BROADCAST_HOSTS:
        near = rest.join(F.broadcast(hosts), same)
    else:
        parts = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = rest.withColumn("_part", F.pmod(F.shiftright("line", 1), F.lit(SALTS)).cast("int")).join(parts.hint("merge"), same & (F.col("_part") == F.col("part")))
    small = near.filter(F.col("n") > F.col("docs") * small_share)
    return counts.filter("above").select("source", "line").unionByName(small.select("source", "line"))


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, small_share: float | None = SMALL_SHARE, min_left: float = MIN_LEFT, long_docs: int = LONG_DOCS, by_row: bool = False) -> DataFrame:
    """docs(doc_id, source, text) -> per row the base columns, base_failed, drop_lines (numbers from 0), left_words, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    stats = common.materialise(_keyed(docs).mapInArrow(_stats, _STATS), "rules-stats")
    above = _lines_above(stats, min_docs, small_share, long_docs, by_row)
    above = common.materialise(above.select(F.col("source").alias("_s"), F.col("line").alias("_l")), "rules-lines")
    above = above.hint("broadcast" if above.count() <= BROADCAST_LINES else "merge")
    each = stats.select("doc_id", "source", "th", F.explode(F.arrays_zip(F.col("line_no").alias("no"), F.col("line_hash").alias("hash"))).alias("x"))
    cut = each.join(above, F.col("source").eqNullSafe(F.col("_s")) & (F.col("x.hash") == F.col("_l")))
    cut = cut.groupBy("doc_id", "source", "th").agg(F.sort_array(F.collect_set("x.no")).alias("drop_lines"))
    cut = cut.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("th").alias("_t"), "drop_lines")
    j = stats.drop("line_hash").join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("th").eqNullSafe(F.col("_t")), "left")
    drop = F.coalesce("drop_lines", F.array().cast("array<int>"))
    zipped = F.arrays_zip(F.col("line_no").alias("no"), F.col("line_words").alias("words"))
    gone = F.aggregate(F.filter(zipped, lambda z: F.array_contains(F.col("drop"), z["no"])), F.lit(0).cast("long"), lambda s, z: s + z["words"])
    j = j.withColumn("drop", drop).withColumn("left_words", F.when(F.size("drop") > 0, F.col("n_words") - gone).otherwise(F.col("n_words")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    j = j.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("left_words") >= F.lit(min_left) * F.col("n_words")))
    return j.select("doc_id", "source", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("drop").alias("drop_lines"), "left_words", "kept")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their lines above the limit removed; all columns of docs, `n_chars` brought up to date."""
    d, s, t, drop, th = common.fresh(docs, "d", "s", "t", "drop", "th")
    ruled = common.materialise(verdicts(docs, **options).filter("kept"), "rules-verdicts")
    ruled = ruled.groupBy("doc_id", "source", "th").agg(F.first("drop_lines").alias(drop))
    ruled = ruled.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("th").alias(t), drop)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (F.col(th) == F.col(t))
    j = docs.withColumn(th, F.xxhash64(F.col("text").cast("string"))).join(ruled.hint("merge"), same)
    stay = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(drop), i))
    j = j.withColumn("text", F.when(F.size(drop) > 0, F.array_join(stay, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(common.table(spark, sf_dir, "documents"), small_share=None, by_row=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", F.size("drop_lines").cast("long").alias("n_lines_removed"), "kept")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(sha256(text), '') AS sha, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
l AS (SELECT r, doc_id, source, sha, x, {_WORDS.format("x")} AS lw FROM (SELECT r, doc_id, source, sha, unnest(string_split(text, chr(10))) AS x FROM d)),
n AS (SELECT r, doc_id, source, sha, x, len(lw) AS nw, array_to_string([translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for y in lw], ' ') AS norm FROM l WHERE len(lw) > 0),
c AS (SELECT source, norm, count(DISTINCT [doc_id::VARCHAR, sha]) AS n FROM n GROUP BY source, norm),
gone AS (SELECT n.r, count(*) AS lines, sum(n.nw) AS words FROM n JOIN c ON c.norm = n.norm AND c.source IS NOT DISTINCT FROM n.source WHERE c.n > CASE WHEN n.nw >= {LONG_WORDS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END GROUP BY n.r),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS dups FROM n GROUP BY r),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, t) >= 2),
rep AS (SELECT r, count(DISTINCT i + k) AS words FROM h, (VALUES (0), (1), (2)) v(k) GROUP BY r),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
  coalesce(rep.words, 0) AS n_repeat_words, len(w) - coalesce(gone.words, 0)::BIGINT AS left_words, coalesce(lines, 0) AS n_lines_removed FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND left_words >= {MIN_LEFT} * n_words AS kept FROM f"""
QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": SQL}
