"""Sinks: partitioned views, canonical JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import shared_dir


def _path(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def partitioned_views(df: DataFrame, by: list[str], path: str | None = None) -> DataFrame:
    """Write df as disjoint child corpora, one folder a value of `by`, and read them back."""
    path = path or _path(df, "views")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def json_lines(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as JSON lines with columns in sorted order, and read them back under the same schema."""
    path = path or _path(df, "lines")
    ordered = df.select(*sorted(df.columns))
    ordered.write.json(path)
    return df.sparkSession.read.schema(ordered.schema).option("mode", "FAILFAST").json(path)


def grouped_views(df: DataFrame, column: str, groups: dict[str, tuple[str, ...]], name: str, sums: list[str], path: str | None = None) -> DataFrame:
    """Write df as child corpora: a view (column `name`) for each group of values of `column`, one for each value in no group, `none` for nulls.

    A value in two groups is refused. What is read back must have the parent's rows and sums, or this fails: nothing is lost or doubled.
    """
    of = [(v, g) for g, values in groups.items() for v in values]
    if len(dict(of)) < len(of):
        raise ValueError("a value is in two groups")
    view = F.coalesce(*[F.when(F.col(column).isin(*values), F.lit(g)) for g, values in groups.items()], F.col(column).cast("string"), F.lit("none"))
    views = partitioned_views(df.withColumn(name, view), [name], path).withColumn(name, F.col(name).cast("string"))
    totals = [F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in sums]]
    parent, child = df.agg(*totals).first(), views.agg(*totals).first()
    if parent != child:
        raise RuntimeError(f"views have {child}, their parent {parent}")
    return views
