"""Splits, samples and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from ..functions.text import hash60


def seeded(seed: int, *cols: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def exact_split(df: DataFrame, identity: str, fraction: float, seed: int) -> DataFrame:
    """df with `split`: the round(n * fraction) first identities by seeded hash are validation (at least 1, at most n - 1)."""
    ids = df.select(identity).distinct()
    ranked = global_rank(ids.withColumn("_h", seeded(seed, F.col(identity))), ["_h", identity], "_pos")
    n = ids.count()
    k = F.least(F.greatest(F.bround(F.lit(n * fraction), 0), F.lit(1)), F.lit(n - 1))
    split = ranked.select(identity, F.when(F.col("_pos") <= k, "validation").otherwise("train").alias("split"))
    return df.join(split, identity)


def bucket(identity: Column, buckets: int = 100, seed: int = 0) -> Column:
    return (hash60(F.lit(seed), identity) % buckets).cast("int")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def apportion(weights: DataFrame, total: int) -> DataFrame:
    """weights(name, weight) -> budget: floors of total * weight / sum, the rest to the largest remainders (then names)."""
    every = Window.partitionBy()
    w = weights.withColumn("_sum", F.sum("weight").over(every))
    w = w.withColumn("_floor", F.floor(F.lit(total) * F.col("weight") / F.col("_sum")).cast("long"))
    w = w.withColumn("_rest", F.lit(total) * F.col("weight") - F.col("_floor") * F.col("_sum"))
    w = w.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("_rest"), "name"))).withColumn("_left", F.lit(total) - F.sum("_floor").over(every))
    return w.select("name", "weight", (F.col("_floor") + (F.col("_k") <= F.col("_left")).cast("long")).alias("budget"))
