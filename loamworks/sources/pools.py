"""Pools of winners by key that grow batch by batch, kept in hash buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import shared_dir, staged


class Winners:
    """Of each key the first row by `order` over all batches, and `occurrences`, the rows seen.

    A batch rewrites the buckets that its keys fall in, and no others, into a folder of its own; then it writes which batch holds
    each bucket's newest rows. A reader goes by the last such list, so that a batch that failed half-way isn't seen. A batch builds
    on the list before its own: run again, it gives the same. Batches are numbered from 0, in order.

    Null keys are a key; rows alike count each; of equal rows by `order` any wins, so let it tell rows apart. An empty batch
    rewrites nothing.
    """

    def __init__(self, spark: SparkSession, schema: str, key: str, order: list[str], buckets: int = 64, path: str | None = None) -> None:
        self.spark, self.key, self.order, self.buckets = spark, key, order, buckets
        self.path = path or f"{shared_dir(spark)}/winners-{uuid.uuid4().hex}"
        self.columns = spark.createDataFrame([], schema).columns
        self.stored = f"{schema}, occurrences long, batch long, bucket int"

    def _list(self, batch: int) -> dict[int, int]:
        """bucket -> batch that wrote it last, as of a batch; one row a bucket."""
        if batch < 0:
            return {}
        rows = self.spark.read.schema("bucket int, held long").parquet(f"{self.path}/lists/batch={batch}").collect()
        return {r.bucket: r.held for r in rows}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        """The stored rows of some buckets; the folders of others aren't read."""
        if not held:
            return self.spark.createDataFrame([], self.stored).drop("batch")
        folders = [f"{self.path}/rows/batch={b}/bucket={k}" for k, b in sorted(held.items())]
        return self.spark.read.schema(self.stored).option("basePath", f"{self.path}/rows").parquet(*folders).drop("batch")

    def current(self, batch: int) -> DataFrame:
        """All winners after a batch: the columns and occurrences."""
        return self._rows(self._list(batch)).select(*self.columns, "occurrences")

    def upsert(self, rows: DataFrame, batch: int) -> dict[str, int]:
        """Add a batch; how many buckets it rewrote, how many rows they hold, and how many keys are new."""
        held = self._list(batch - 1)
        rest = [c for c in self.columns if c != self.key]

        def merged(df: DataFrame) -> DataFrame:
            best = df.groupBy(self.key, "bucket").agg(F.min_by(F.struct(*rest), F.struct(*self.order)).alias("_r"), F.sum("occurrences").alias("occurrences"))
            return best.select(self.key, *[F.col(f"_r.{c}").alias(c) for c in rest], "occurrences", "bucket")

        fresh = rows.select(*self.columns, F.lit(1).cast("long").alias("occurrences")).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        fresh = staged(merged(fresh), "winners-batch")
        touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}
        before = self._rows({k: b for k, b in held.items() if k in touched}).select(*fresh.columns)
        path = f"{self.path}/rows/batch={batch}"
        if touched:
            merged(before.unionByName(fresh)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        now = held | dict.fromkeys(touched, batch)
        self.spark.createDataFrame(list(now.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch={batch}")
        n = self._rows({k: batch for k in touched}).count()
        return {"buckets": len(touched), "rows": n, "added": n - before.count()}
