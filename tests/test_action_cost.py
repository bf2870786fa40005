"""Scoring a stream names each value once: a plan's size shows what is made again."""

from pyspark.sql import functions as F

from loamworks.operators.actions import ACTION, stream_score
from loamworks.plans.standins import actions


def test_values_of_a_stream_are_scored_once(spark):
    df = spark.sql(f"SELECT CAST(NULL AS array<{ACTION}>) AS g, CAST(NULL AS array<{ACTION}>) AS p FROM range(2)")
    plan = df.select(stream_score(F.col("g"), F.col("p")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("levenshtein(") == 1


def test_lines_are_read_once_for_both_sides(spark):
    plan = actions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
