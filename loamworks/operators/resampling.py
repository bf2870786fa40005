"""Bootstrap grids with hashed draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from ..functions.text import hash60
from ..sources.stages import staged


def bootstrap(clusters: DataFrame, key: str, resamples: int, seed: int) -> GroupedData:
    """Rows of clusters drawn with replacement, grouped by resample: as many draws each as there are clusters.

    Draw i of resample r takes cluster hash(seed, r, i) mod n, so the grid is made where it is needed and is the same on
    every run. Aggregate rows to clusters first: the grid has resamples * clusters rows.
    """
    numbered = staged(global_rank(clusters, [key], "_k"), "clusters")
    n = numbered.count()
    spark = clusters.sparkSession
    grid = spark.range(resamples * max(n, 1)).select(F.expr(f"id div {max(n, 1)}").alias("resample"), (F.col("id") % max(n, 1)).alias("i"))
    draws = grid.select("resample", (hash60(F.lit(seed), F.col("resample"), F.col("i")) % max(n, 1) + 1).alias("_k"))
    return draws.join(numbered.hint("merge"), "_k").groupBy("resample")
