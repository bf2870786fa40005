"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions of documents.

Each source has a weight and may be repeated at most max_epochs times. Shares of the wanted total are given by weight;
sources whose share is above their cap are clamped there and the excess is shared among the rest by weight, until none
is above. A source's target then is taken as floor(target / size) whole repetitions and one partial one, which holds
the first documents in a seeded order up to the target.

Nulls: a null text has size 0, a null source is a source of its own (last in the order), null ids are documents as others.
Empty table: an empty result. Documents of size 0 take 0 words. Very long texts count by their words; one that is larger than
the rest of its source's target is left out if that is nearer. Ties of the order go by doc_id and size; what ties there too is
alike to the plan. Repeated rows count each. Extra columns are ignored by the plan and kept by `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import global_rank, rank_within
from . import common

SEED = 20260
MAX_EPOCHS = 2.0
TOTAL_SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes(source, weight, source_size) with target: water-filling of total_share of all sizes under the caps.

    The level L (words per unit of weight) decides who is clamped: cap < L * weight. Clamping frees words for the
    others, which only raises L, so the loop ends when no further source is clamped. A round is one aggregate.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level, clamped = 0.0, -1
    while True:
        above = cap < F.lit(level) * F.col("weight")
        row = sizes.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count_if(above).alias("n"),
        ).first()
        if row.n == clamped or row.free == 0:
            break
        clamped, level = row.n, (total - row.fixed) / row.free
    return sizes.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def cycle_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weights dealt in turn over the sources in the order of their names, null last."""
    turn = (F.col("_turn") - 1) % len(weights)
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_turn")
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).drop("_turn")


def take_plan(slim: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """slim(row, doc_id, source, size, ...) with source_size, target, copies and taken (words the mix takes of the row)."""
    slim = rank_within(slim.withColumn("_h", common.seeded_key(seed, F.col("doc_id"))), "source", ["_h", "doc_id", "size", "row"], "_cum", "_all", F.col("size"))
    plan = targets.select(F.col("source").alias("_src"), "source_size", "target").hint("broadcast" if targets.count() <= 10_000 else "merge")
    j = slim.join(plan, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    part = F.col("target") - whole * F.col("source_size")
    extra = ((F.col("size") > 0) & (F.col("_cum") + F.col("size") / 2 <= part)).cast("long")
    return j.withColumn("copies", whole + extra).withColumn("taken", F.col("size") * F.col("copies")).drop("_h", "_cum", "_all")


def _planned(docs: DataFrame, seed: int, total_share: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """plan(), with the texts' hashes."""
    text = F.col("text").cast("string")
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), common.word_count(text).alias("size"), F.xxhash64(text).alias("th"))
    slim = common.materialise(slim.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sizes = cycle_weights(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    return take_plan(slim, source_targets(common.materialise(sizes, "mix-sources"), total_share, max_epochs), seed)


def plan(docs: DataFrame, seed: int = SEED, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken. Texts are read once."""
    return _planned(docs, seed, total_share, max_epochs, weights).drop("row", "th")


def mix(docs: DataFrame, seed: int = SEED, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: each row as often as its plan says (0, 1, 2 ... rows), all its columns kept.

    What the plan takes of rows alike in doc_id, source and text is dealt out to them evenly, the rest to the first ones.
    """
    d, s, th, n, like, row, k, m, times = common.fresh(docs, "d", "s", "th", "n", "like", "row", "k", "m", "times")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    copies = _planned(docs, seed, total_share, max_epochs, weights).groupBy("doc_id", "source", "th").agg(F.sum("copies").alias(times), F.count("*").alias(n))
    copies = common.materialise(copies.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("th").alias(th), times, n).filter(F.col(times) > 0), "mix-copies")
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (text_hash == F.col(th))
    joined = docs.join(copies.filter(F.col(n) == 1).hint("merge"), same).select(*docs.columns, times)
    several = copies.filter(F.col(n) > 1)
    if several.limit(1).count():
        rows = docs.join(several.hint("merge"), same).withColumn(like, F.xxhash64("doc_id", "source", th)).withColumn(row, F.monotonically_increasing_id())
        rows = rank_within(rows, like, [row], k, m)
        share = F.floor(F.col(times) / F.col(n)) + (F.col(k) <= F.col(times) % F.col(n)).cast("long")
        joined = joined.unionByName(rows.withColumn(times, share).filter(F.col(times) > 0).select(*docs.columns, times))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), F.col("taken").cast("long").alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, {MAX_EPOCHS} * source_size / weight AS ratio, {TOTAL_SHARE} * sum(source_size) OVER () AS total,
  coalesce(sum({MAX_EPOCHS} * source_size) OVER (ORDER BY {MAX_EPOCHS} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
  sum(weight) OVER (ORDER BY {MAX_EPOCHS} * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s),
l AS (SELECT coalesce(arg_min((total - fixed) / free, ratio) FILTER (WHERE ratio >= (total - fixed) / free), 0) AS level FROM o),
t AS (SELECT source, source_size, least({MAX_EPOCHS} * source_size, level * weight) AS target FROM s, l),
h AS (SELECT d.*, source_size, target, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 15))::BIGINT AS h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM h)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target,
  (size * (whole + CASE WHEN cum + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": SQL}
