"""Total orders, of all rows or within keys, without a window that holds everything or all of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import staged


def global_rank(df: DataFrame, order: list, out: str, amount: Column | None = None) -> DataFrame:
    """df with `out`: the 1-based rank of each row in the order (or, with amount, its sum over all earlier rows).

    Rows are dealt out in ranges of the order and numbered within their range; each range's offset is the sum over
    the ranges before it. The ranges are written once, so that offsets and rows agree even if an executor is lost. The
    order must be total.
    """
    counted = amount is None
    inner = Window.partitionBy("_range").orderBy(*order)
    ranged = staged(df.withColumn("_amount", F.lit(1).cast("long") if counted else amount).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    earlier = F.coalesce(F.sum("_amount").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("_earlier", earlier).join(offsets.hint("merge"), "_range")
    value = F.col("_before") + F.col("_earlier")
    return ranked.withColumn(out, value + 1 if counted else value).drop("_range", "_amount", "_before", "_earlier")


def rank_within(df: DataFrame, key: str, order: list[str], out: str, total: str, amount: Column | None = None) -> DataFrame:
    """df with `out`, the 1-based rank of each row among those of its key (or, with amount, its sum over the key's earlier
    rows), and `total`, the key's number of rows (or sum). A null key is one too.

    Rows are dealt out in ranges of (key, order), so that a hot key is many ranges, and numbered within key and range; a
    key's offsets are one row a range. The order must be total within a key.
    """
    value = F.lit(1).cast("long") if amount is None else amount
    ranged = staged(df.withColumn("_amount", value).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.sum("_amount").alias("_sum"))
    every = Window.partitionBy("_key")
    before = every.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_key", "_of", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(every).alias(total))
    inner = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.withColumn("_earlier", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    joined = joined.join(offsets.hint("merge"), (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    rank = F.col("_before") + F.col("_earlier")
    return joined.withColumn(out, rank + 1 if amount is None else rank).drop("_range", "_amount", "_earlier", "_key", "_of", "_before")
