"""Streaming jobs: file sources, stateful transformations, and outputs that a restart doesn't change.

Each job reads what has arrived, processes it as micro-batches (trigger availableNow) and ends; started again with the
same checkpoint it handles new files only. Outputs go to the shared folder: a file sink for append mode, or one folder
a batch, overwritten if the batch is run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contamination, filters
from ..sources.stages import shared_dir, staged

WATERMARK = "1 hour"
#: Accuracy of the windows' quantile sketch, which is part of their state: a rank is off by n / SKETCH at most.
SKETCH = 10_000


def source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern, since the stream takes a plain path for a folder, and a table may be one file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def arriving(spark: SparkSession, parts: list[DataFrame], files: int = 2) -> DataFrame:
    """The parts as a stream, in the order given: each is written as files of its own, and a micro-batch takes one part."""
    base = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        part.repartition(files).write.option("maxRecordsPerFile", 0).parquet(f"{base}/part={i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{base}/part=*")


class Job:
    """Where a job keeps its output and its checkpoint; the same job object can be run again."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.out, self.checkpoint = f"{base}/out", f"{base}/checkpoint"

    def append(self, df: DataFrame) -> DataFrame:
        q = df.writeStream.format("parquet").outputMode("append").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.schema(df.schema).parquet(self.out)

    def batches(self, df: DataFrame, each: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
        """each(batch) is written to the batch's own folder; read back with the column `batch`. Without any batch there are no rows."""
        seen = []

        def write(batch: DataFrame, k: int) -> None:
            each(batch).write.mode("overwrite").parquet(f"{self.out}/batch={k}")
            seen.append(k)

        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if not seen:
            return each(self.spark.createDataFrame([], df.schema)).limit(0).withColumn("batch", F.lit(0))
        return self.spark.read.parquet(self.out)

    def each(self, df: DataFrame, do: Callable[[DataFrame, int], None]) -> int:
        """do(batch, its number) for every micro-batch; the last one's number, -1 if there was none."""
        seen = [-1]

        def run(batch: DataFrame, k: int) -> None:
            do(batch, k)
            seen.append(k)

        df.writeStream.foreachBatch(run).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()
        return max(seen)


def timed(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def deadline_windows(events: DataFrame, deadline: float, width: str = "1 day") -> DataFrame:
    """Tumbling windows of attempts: on time and successful at the deadline. Rows later than the watermark are dropped; a window is given once it is closed."""
    ok = (F.col("event_id") % 3 != 0) & (F.col("event_type") != "error") & (F.col("value") <= deadline)
    w = timed(events).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("value") <= deadline).alias("on_time"), F.count_if(ok).alias("successes"), F.percentile_approx("value", 0.5, SKETCH).alias("p50"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "on_time", "successes", "p50")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Steps of a user gathered until a gap of inactivity; only closed sessions are given."""
    s = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("steps"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "steps", "total")


def pool(documents: DataFrame) -> DataFrame:
    """New fingerprints of acceptable documents; the state remembers those seen before, across restarts."""
    d = filters.with_reject_reason(documents).filter("reject_reason IS NULL").select(tx.digest(F.col("text")).alias("digest"))
    return d.dropDuplicates(["digest"])


def screen(batch: DataFrame, denylist: DataFrame) -> DataFrame:
    """A batch of documents against a static denylist and the privacy rules: entries found, reasons, and whether the document stays."""
    d = staged(batch.select("doc_id", filters.privacy_reasons(F.col("text")).alias("reasons"), tx.folded(F.col("text")).alias("t")), "batch")
    hits = contamination.contained(d, denylist).groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("entries"))
    j = d.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    return j.select("doc_id", "entries", F.array_join("reasons", ",").alias("reasons"), ((F.col("entries") == 0) & (F.size("reasons") == 0)).alias("kept"))
