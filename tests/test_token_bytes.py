"""Tokens made in Python against the column function, for all of Latin-1 and beyond."""

import random

from pyspark.sql import functions as F

from loamworks.functions import text as tx
from loamworks.operators import dedup, filters


def test_token_bytes_equal_the_columns(spark):
    rnd = random.Random(2)
    latin = [chr(i) for i in range(256)]
    beyond = [chr(i) for i in (0x130, 0x131, 0x178, 0x301, 0x3A3, 0x1E9E, 0x200D, 0x2028, 0x2074, 0x2167, 0x3000, 0x4E00, 0x10400, 0x1F600)]
    texts = [None, "", " ", "\xa0", "\x85\x1c"] + [a + b + c for a in "aÀ _" for b in latin for c in "zÉ ."]
    texts += ["".join(rnd.choice(latin + beyond * (k % 2)) for _ in range(rnd.randint(1, 60))) for k in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.token_text(F.col("t")).alias("given"), F.array_join(tx.tokens(F.col("t")), " ").alias("want")).collect():
        assert tx.token_bytes(r.given) == (r.want or "").encode(), repr(r.t)


def test_packed_sets_are_the_arrays(spark):
    texts = ["a b c d e f a b c d e f", "one", "", None, "Ünïcode, größer — 日本 語 x, y!", "x " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    arrays, packed = ({r.i: r for r in dedup.signatures(df, packed=p).collect()} for p in (False, True))
    for i in range(len(texts)):
        assert bytes(packed[i].hashes) == b"".join(h.to_bytes(8, "little", signed=True) for h in arrays[i].hashes)
        assert [packed[i][c] for c in ("features", "sim_hi", "sim_lo", "set_id")] == [arrays[i][c] for c in ("features", "sim_hi", "sim_lo", "set_id")]


def test_code_signs_in_texts_with_and_without_their_characters(spark):
    texts = ["def f\nimport x", "def f\nx = 1", "import a\nlet b = 2", "class A\n#include", "def f\n#define", "from x\na;", "{\n  def x", "}", "const q =\n#!/", "plain; text = {here} #1", "let me\nimport it", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    signs = sum(F.coalesce(F.substring("t", 1, filters.CODE_SAMPLE).rlike(p).cast("int"), F.lit(0)) for p in filters.CODE_SIGNS)
    rows = df.select(filters.code_like(F.col("t"), F.lit("s")).alias("got"), (signs >= 2).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and 3 < sum(r.got for r in rows) < 10
