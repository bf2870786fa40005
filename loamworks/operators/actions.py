"""Scores of predicted streams of screen actions, as column expressions over arrays of actions.

An action is a struct: type, x, y, text, keys (array), amount, way (a direction in words), seconds, status, boxes (array of
left, top, width, height; where a click counts as a hit). Fields that a type doesn't use are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

ACTION = "struct<type: string, x: double, y: double, text: string, keys: array<string>, amount: double, way: string, seconds: double, status: string, boxes: array<struct<left: double, top: double, width: double, height: double>>>"
# Distance at which a point still counts whole, decay beyond it, similarity from which a text counts whole.
NEAR, DECAY, SIMILAR = 0.01 * 2**0.5, 120.0, 0.8
POINTS = ("click", "doubleclick", "rightclick", "middleclick", "tripleclick", "moveto", "dragto")
FORWARD, BACKWARD = ("up", "positive", "right"), ("down", "negative", "left")


def kind(action: Column) -> Column:
    return F.lower(action["type"])


def plain_keys(action: Column) -> Column:
    return F.transform(F.coalesce(action["keys"], F.array().cast("array<string>")), F.lower)


def merged(actions: Column, enters: tuple[str, ...]) -> Column:
    """A `write` and the key of enter or return (of a type in `enters`) behind it are one `write` whose text ends with a newline."""

    def enter(a: Column) -> Column:
        keys = plain_keys(a)
        return F.coalesce(kind(a).isin(*enters) & (F.size(keys) == 1) & keys[0].isin("enter", "return"), F.lit(False))

    def joined(a: Column, i: Column) -> Column:
        text = F.when((kind(a) == "write") & enter(F.get(actions, i + 1)), F.concat(F.coalesce(a["text"], F.lit("")), F.lit("\n"))).otherwise(a["text"])
        gone = enter(a) & F.coalesce(kind(F.get(actions, i - 1)) == "write", F.lit(False))
        return F.struct(a.withField("text", text).alias("action"), gone.alias("gone"))

    return F.transform(F.filter(F.transform(actions, joined), lambda x: ~x["gone"]), lambda x: x["action"])


def in_boxes(x: Column, y: Column, boxes: Column) -> Column:
    return F.coalesce(F.exists(boxes, lambda b: x.between(b["left"], b["left"] + b["width"]) & y.between(b["top"], b["top"] + b["height"])), F.lit(False))


def direction(amount: Column, way: Column) -> Column:
    """1, -1 or 0, of a number or of a word."""
    said = lambda word: F.when(word.isin(*FORWARD), 1).when(word.isin(*BACKWARD), -1).otherwise(F.coalesce(F.signum(word.try_cast("double")).cast("int"), F.lit(0)))
    return F.when(amount.isNotNull(), F.signum(amount).cast("int")).otherwise(F.coalesce(tx.let(F.lower(F.regexp_replace(way, r"^\s+|\s+$", "")), said), F.lit(0)))


def _alike(gold: Column, pred: Column) -> Column:
    longest = F.greatest(F.length(gold), F.length(pred))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(pred, gold) / longest)


def value_score(gold: Column, pred: Column, type_: Column | None = None) -> Column:
    """How well pred does what gold asks for, 0 to 1; both are of one type, in lower case `type_` where that is at hand."""
    far = F.hypot(pred["x"] - gold["x"], pred["y"] - gold["y"])
    point = F.when(in_boxes(pred["x"], pred["y"], gold["boxes"]) | (far <= NEAR), 1.0).otherwise(F.exp(-DECAY * (far - NEAR)))
    text = lambda a: F.lower(F.regexp_replace(F.coalesce(a["text"], F.lit("")), r"^\s+|\s+$", ""))
    alike = tx.let(F.struct(text(gold).alias("g"), text(pred).alias("p")), lambda x: _alike(x["g"], x["p"]))
    write = tx.let(alike, lambda x: F.when(x >= SIMILAR, 1.0).otherwise(x / SIMILAR))
    low, high = F.least(F.abs(gold["amount"]), F.abs(pred["amount"])), F.greatest(F.abs(gold["amount"]), F.abs(pred["amount"]))

    def scrolled(way: Column) -> Column:
        asked, given = way["asked"], way["given"]
        return F.when((asked != 0) & (asked != given), 0.0).when(low.isNotNull() & gold["amount"].isNotNull() & pred["amount"].isNotNull(), F.when(high == 0, 1.0).otherwise(low / high)).otherwise((asked == given).cast("double"))

    scroll = tx.let(F.struct(direction(gold["amount"], gold["way"]).alias("asked"), direction(pred["amount"], pred["way"]).alias("given")), scrolled)

    def rules(t: Column) -> Column:
        by = F.when(t.isin(*POINTS), point).when(t == "write", write).when(t.isin("press", "hotkey"), (plain_keys(pred) == plain_keys(gold)).cast("double"))
        by = by.when(t.isin("scroll", "hscroll"), scroll).when(t == "wait", (pred["seconds"] == F.coalesce(gold["seconds"], F.lit(0.0))).cast("double"))
        return F.coalesce(by, F.lit(0.0))

    return tx.let(kind(gold), rules) if type_ is None else rules(type_)


def stream_score(gold: Column, pred: Column) -> Column:
    """Struct of total, first (whether the first type predicted is asked for at all), penalty, n_gold, n_pred, by_type (array of type and score).

    Streams are aligned by position after merging; a type's score is the mean over its gold actions times the penalty for predicting
    too many, the total their mean. An empty stream scores 0 without penalty. If gold begins with `terminate`, the first prediction
    decides all; elsewhere `terminate` counts for nothing. Null arrays are empty; ties don't occur.
    """
    none = F.array().cast(f"array<{ACTION}>")
    gold, pred = F.coalesce(gold, none), F.coalesce(pred, none)
    empty = (F.size(gold) == 0) | (F.size(pred) == 0)
    return F.transform(F.array(F.struct(gold.alias("g"), pred.alias("p"))), lambda x: _of_merged(merged(x["g"], ("press", "hotkey")), merged(x["p"], ("press",)), empty, x))[0]


def _of_merged(gold: Column, pred: Column, empty: Column, raw: Column) -> Column:
    """Each step is a row of its own (let), since an expression inside a lambda is made again wherever it is named."""

    def gated(s: Column) -> Column:
        g, p, kinds = s["g"], s["p"], s["kinds"]
        first_g, first_p, type_p = F.get(g, F.lit(0)), F.get(p, F.lit(0)), F.get(s["given"], F.lit(0))
        penalty = F.when(F.size(p) > F.size(g), F.size(g) / F.size(p)).otherwise(F.lit(1.0))
        ends = F.get(kinds, F.lit(0)) == "terminate"
        first = F.when(ends, type_p == "terminate").otherwise(F.array_contains(kinds, type_p))
        ended = F.when(ends, ((type_p == "terminate") & first_p["status"].eqNullSafe(first_g["status"])).cast("double"))
        return F.struct(s["g"].alias("g"), s["p"].alias("p"), kinds.alias("kinds"), s["given"].alias("given"), ends.alias("ends"), first.alias("first"), penalty.alias("penalty"), (penalty * ended).alias("ended"))

    def valued(s: Column) -> Column:
        def value(a: Column, i: Column) -> Column:
            t, b = F.get(s["kinds"], i), F.get(s["p"], i)
            return F.struct(t.alias("type"), F.when(F.get(s["given"], i) == t, value_score(a, b, t)).otherwise(0.0).alias("s"))

        # Where the first type decides all, or closes the gate, no value counts.
        each = F.when(s["first"] & ~F.coalesce(s["ends"], F.lit(False)), F.transform(s["g"], value))
        return F.struct(*[s[c].alias(c) for c in ("kinds", "ends", "first", "penalty", "ended")], F.size(s["g"]).alias("n_gold"), F.size(s["p"]).alias("n_pred"), each.alias("each"))

    def typed(s: Column) -> Column:
        def of_type(t: Column) -> Column:
            mine = tx.let(F.filter(s["each"], lambda e: e["type"] == t), lambda m: F.aggregate(m, F.lit(0.0), lambda acc, e: acc + e["s"]) / F.size(m))
            return F.struct(t.alias("type"), F.when(s["first"], mine * s["penalty"]).otherwise(0.0).alias("score"))

        stays = F.filter(F.array_distinct(s["kinds"]), lambda t: ~s["first"] | (t != "terminate"))
        by_type = F.when(s["ends"], F.array(F.struct(F.lit("terminate").alias("type"), s["ended"].alias("score")))).otherwise(F.transform(stays, of_type))
        return F.struct(*[s[c].alias(c) for c in ("ended", "first", "penalty", "n_gold", "n_pred")], by_type.alias("by_type"))

    def closed(x: Column) -> Column:
        total = F.when(F.size(x["by_type"]) == 0, 0.0).otherwise(F.aggregate(x["by_type"], F.lit(0.0), lambda acc, e: acc + e["score"]) / F.size(x["by_type"]))
        return F.struct(F.coalesce(x["ended"], total).alias("total"), x["first"].alias("first"), x["penalty"].alias("penalty"), x["n_gold"].alias("n_gold"), x["n_pred"].alias("n_pred"), x["by_type"].alias("by_type"))

    nothing = F.struct(F.lit(0.0).alias("total"), F.lit(False).alias("first"), F.lit(1.0).alias("penalty"), F.size(raw["g"]).alias("n_gold"), F.size(raw["p"]).alias("n_pred"), F.array().cast("array<struct<type: string, score: double>>").alias("by_type"))
    both = tx.let(F.struct(gold.alias("g"), pred.alias("p")), lambda x: F.struct(x["g"].alias("g"), x["p"].alias("p"), F.transform(x["g"], kind).alias("kinds"), F.transform(x["p"], kind).alias("given")))
    whole = tx.let(tx.let(tx.let(tx.let(both, gated), valued), typed), closed)
    return F.when(empty, nothing).otherwise(whole)
