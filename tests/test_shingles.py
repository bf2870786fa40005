"""Hashed shingles against shingles as columns, and that a batch is worked through in pieces."""

import pandas as pd
from pyspark.sql import functions as F

from loamworks.functions import text as tx


def test_hashed_shingles_equal_the_columns(spark):
    texts = ["a b c d e f a b c d e f", "one", "", None, "Ünïcode, größer — 日本 語 x, y!", "a b c d e", "a  b\tc d\ne\r\nf", "x " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df = tx.with_shingles(df.withColumn("got", tx.hashed_shingles(F.col("text"), 5)), 5)
    for r in df.select("got", F.transform("s", lambda x: F.substring(F.sha2(x, 256), 1, 16)).alias("want")).collect():
        assert sorted(f"{h % 2**64:016x}" for h in r.got) == sorted(r.want) and r.got == sorted(r.got)


def test_a_batch_is_worked_through_in_pieces():
    texts = pd.Series(["x" * (tx.PIECE // 2), None, "x" * tx.PIECE, "", "y"])
    parts = list(tx.pieces(texts))
    assert [x for p in parts for x in p] == texts.tolist() and len(parts) == 2
