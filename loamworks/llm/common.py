"""Helpers the training-data operators share: table access, stage outputs, two-level ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import shared_dir, table

__all__ = ["bucket_of", "fresh", "materialise", "release", "running_total", "seeded_key", "shared_dir", "table", "word_count"]

#: A word, everywhere in this subpackage: a run of characters other than these six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rank buckets a key. Ranks within a bucket are windows over 1/4096 of a key's rows.
RANK_BUCKETS = 4096


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them (in any case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def seeded_key(seed: int, *cols: Column) -> Column:
    """60 bits of sha256(seed:values): the same in every engine, so that SQL can follow an order by it."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256), 1, 15), 16, 10).cast("long")


def bucket_of(key: Column, buckets: int = RANK_BUCKETS) -> Column:
    """Bucket of a 60-bit key, in the order of the keys."""
    return F.shiftright(key, 60 - (buckets - 1).bit_length()).cast("int")


def running_total(df: DataFrame, keys: list[str], key60: str, ties: list[str], amount: Column, out: str) -> DataFrame:
    """df with `out`: the sum of amount over the earlier rows of the same keys, in the order (key60, ties).

    Two levels, so that a hot key isn't one task: totals of each key's buckets are summed up in order, and rows are
    summed within their bucket. Both levels share one shuffle of df on (keys, bucket).
    """
    df = df.withColumn("_b", bucket_of(F.col(key60))).withColumn("_a", amount)
    at = [F.coalesce(F.col(k).cast("string"), F.lit("\x00null")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumns(dict(zip(names, at)))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*names, "_b").agg(F.sum("_a").alias("_s"))
    sums = sums.select(*names, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*names, "_b").orderBy(key60, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_in", F.coalesce(F.sum("_a").over(inner), F.lit(0)))
    return ranked.join(sums.hint("merge"), [*names, "_b"]).withColumn(out, F.col("_before") + F.col("_in")).drop(*names, "_b", "_a", "_s", "_before", "_in")
