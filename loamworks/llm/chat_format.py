"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply is trainable.
A conversation whose last turn isn't an assistant's also gets a closing example without a trainable part, so that no
turn is lost. A turn is written as  <s>[role]\\n text </s> ; inside roles and texts & < [ ] become &amp; &lt; &#91; &#93;
so that no control string can come from a text, and reading back is exact.

Nulls: a null text is empty, a null role reads back as the empty role; a null conv_id is a conversation of its own,
null turns come first. Ties in turn are ordered by role and text, and repeated rows stay repeated. Empty table: no examples. Very long
texts are written whole. Other columns aren't read, whatever their names. The query adds a conversation -1 of its own; rows of the table
with that id would be turns of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<s>", "</s>"
#: Control characters of the template and what stands for them inside roles and texts; undone in reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit(f"{OPEN}["), escape(role), F.lit("]\n"))


def format_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples (conv_id, example, last_turn, formatted, loss_start, loss_chars); spans are code points, start from 0.

    loss_start is null in a closing example. One shuffle, on conv_id.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    pieces = F.transform("ts", lambda t: F.struct((t["role"] == target_role).alias("target"), _head(t["role"]).alias("head"), escape(t["text"]).alias("body")))
    n = F.size("p")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("p", i)["target"] | (i == n))
    ex = convs.select("conv_id", pieces.alias("p")).select("conv_id", "p", F.posexplode(ends).alias("example", "end"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))
    context = F.array_join(F.transform(F.slice("p", F.lit(1), F.col("end") - 1), whole), "")
    last = F.element_at("p", F.col("end"))
    ex = ex.select("conv_id", "example", F.col("end").cast("long").alias("last_turn"), context.alias("context"), last.alias("last"))
    return ex.select(
        "conv_id", F.col("example").cast("long").alias("example"), "last_turn",
        F.concat("context", whole(F.col("last"))).alias("formatted"),
        F.when(F.col("last.target"), F.length("context") + F.length("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("last.target"), F.length("last.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted example."""
    raw = F.filter(F.split(formatted, OPEN, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.locate("]\n", x)
        return F.struct(unescape(F.substring(x, F.lit(2), cut - 2)).alias("role"), unescape(F.substring(x, cut + 2, F.length(x) - cut - 1 - len(CLOSE))).alias("text"))

    return F.transform(raw, turn)


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped; null if it has none."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the written examples. formatted_chars: code points of the conversation's longest example."""
    both = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    conversations = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    examples = common.materialise(format_examples(conversations), "chat-examples")
    loss = examples.select("conv_id", "example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"))
    # Only the longest example is parsed for the turns; of the others, only the trainable part.
    part = loss.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda s: F.coalesce(s["loss"], F.lit(""))), "").alias("loss"))
    top = examples.groupBy("conv_id").agg(F.max("example").alias("example"))
    full = examples.join(top.hint("merge"), (examples["conv_id"].eqNullSafe(top["conv_id"])) & (examples["example"] == top["example"]), "left_semi")
    full = full.select(F.col("conv_id").alias("_c"), read_turns(F.col("formatted")).alias("turns"), F.length("formatted").alias("formatted_chars"))
    joined = part.join(full.hint("merge"), part["conv_id"].eqNullSafe(full["_c"]))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return joined.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))
  + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) + 10 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
QUERIES = {"op8_chat_format": op8_chat_format}
ORACLES = {"op8_chat_format": SQL}
