"""Exact interpolated percentiles from counts by value, so that no task holds all values of a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import rank_within


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """df -> key and, for each name of `shares`, the value at (n - 1) * share in the key's order, interpolated. Nulls don't count.

    Equal values are one row with a count; these are ranked in ranges of (key, value), and an aggregate of two values a
    share picks what lies at both sides of the place.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    r = rank_within(counts, "_k", ["_v"], "_at", "_n", F.col("_c"))
    aggs = []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(float(share))
        holds = lambda x: (F.col("_at") <= x) & (x < F.col("_at") + F.col("_c"))
        aggs += [F.max(F.when(holds(F.floor(place)), F.col("_v"))).alias(f"_low_{name}"), F.max(F.when(holds(F.ceil(place)), F.col("_v"))).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    r = r.groupBy("_k").agg(*aggs)
    between = lambda n: F.col(f"_low_{n}") * (1 - F.col(f"_part_{n}")) + F.col(f"_high_{n}") * F.col(f"_part_{n}")
    return r.select(F.col("_k").alias(key), *[between(n).alias(n) for n in shares])
