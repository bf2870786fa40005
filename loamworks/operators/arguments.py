"""Arguments of calls: reading calls out of free text, flattening nested arguments, fingerprints of prompts without their arguments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as tx
from ..sources.stages import staged

_CALL = StructType([StructField(c, StringType()) for c in ("name", "args", "kind")])
CALLS = StructType([StructField("calls", ArrayType(_CALL)), StructField("failures", IntegerType())])
#: Levels of nested arguments that a round opens.
LEVELS = 4
_BRACE = re.compile("[{}]")
_DECODER = json.JSONDecoder()
_NAMED = re.compile(r'"name"\s*:\s*"([^"]+)"')
_PLAIN = re.compile(r"([A-Za-z_][\w.-]*)\(")
_PAIR = re.compile(r"\s*([A-Za-z_]\w*)\s*=\s*")
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)


def _end_of(text: str, start: int) -> int:
    """Behind the brace that closes the one at start, by depth alone; the text's end if none does."""
    depth = 0
    for m in _BRACE.finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _named(value: object) -> list[tuple[str, str, str]]:
    """The calls of parsed JSON: the object itself if it names one, else those inside it."""
    if isinstance(value, dict):
        name = next((value[k] for k in ("name", "function", "tool") if value.get(k)), None)
        if isinstance(name, str):
            args = next((value[k] for k in ("arguments", "parameters", "args") if value.get(k)), {})
            if isinstance(args, str):
                try:
                    args = json.loads(args)
                except ValueError:
                    args = {}
            return [(name, _canonical(args if isinstance(args, dict) else {}), "json")]
        return [c for v in value.values() for c in _named(v)]
    return [c for v in value for c in _named(v)] if isinstance(value, list) else []


def _typed(raw: str) -> object:
    raw = raw.strip()
    try:
        return json.loads(raw)
    except ValueError:
        pass
    word = {"True": True, "False": False, "None": None}
    return word[raw] if raw in word else raw[1:-1].replace("\\'", "'") if len(raw) > 1 and raw[0] == raw[-1] == "'" else raw


def _split(text: str) -> list[str]:
    """Parts between commas that no bracket or quote holds."""
    parts, depth, at, i = [], 0, 0, 0
    while i < len(text):
        quoted = _QUOTED.match(text, i) if text[i] in "\"'" else None
        if quoted:
            i = quoted.end()
            continue
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if text[i] == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
        i += 1
    return parts + [text[at:]]


def _plain(text: str) -> list[tuple[str, str, str]]:
    """Calls spelled name(key=value, ...), of any nesting in their values; arguments without a key are numbered."""
    out, at = [], 0
    while (m := _PLAIN.search(text, at)) is not None:
        depth, i = 1, m.end()
        while i < len(text) and depth:
            quoted = _QUOTED.match(text, i) if text[i] in "\"'" else None
            i = quoted.end() if quoted else i + 1
            if not quoted:
                depth += (text[i - 1] == "(") - (text[i - 1] == ")")
        if depth:
            at = m.end()
            continue
        inner = text[m.end() : i - 1]
        args: dict[str, object] = {}
        for k, part in enumerate(_split(inner) if inner.strip() else []):
            pair = _PAIR.match(part)
            args[pair[1] if pair else str(k)] = _typed(part[pair.end() :] if pair else part)
        out.append((m[1], _canonical(args), "plain"))
        at = i
    return out


def read_calls(text: str | None) -> tuple[list[tuple[str, str, str]], int]:
    """(calls as name, arguments and spelling; outermost objects that neither are JSON nor hold a call) of a text.

    Every brace may begin an object. Where one doesn't parse, those inside it are tried.
    """
    text = text or ""
    calls: list[tuple[str, str, str]] = []
    failures = at = broken = held = 0
    while (start := text.find("{", at)) >= 0:
        if broken and start >= broken:
            failures += len(calls) == held
            broken = 0
        try:
            value, at = _DECODER.raw_decode(text, start)
            calls += _named(value)
        except (ValueError, RecursionError):
            if not broken:
                broken, held = _end_of(text, start), len(calls)
            at = start + 1
    failures += bool(broken) and len(calls) == held
    if not calls:
        named = _NAMED.search(text)
        calls = [(named[1], "{}", "name")] if named else _plain(text)
    return calls, failures


@F.pandas_udf(CALLS)
def parse_calls(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Calls of each text, in batches: JSON objects at any depth, else a bare "name", else name(key=value). Null and empty texts have none."""
    for batch in text:
        rows = [read_calls(t) for t in batch]
        yield pd.DataFrame({"calls": [[dict(zip(("name", "args", "kind"), c)) for c in calls] for calls, _ in rows], "failures": pd.Series([n for _, n in rows], dtype="int32")})


def leaf_slots(df: DataFrame, value: str, nulls: bool = False) -> DataFrame:
    """df with a row for each leaf of the VARIANT column `value`, in place of it: path, type (int, float, str, bool), leaf (JSON).

    Containers are opened LEVELS levels a round, as many rounds as they nest; each round is written. An object adds its key to the path, a list
    nothing; a bare value has the path `value`. Empty containers have no row, nor has a null value; null leaves have one if `nulls` (type null).
    """
    keys = [c for c in df.columns if c != value]
    state = df.select(*keys, F.lit("").alias("path"), F.col(value).alias("_v"))  # null values go at the end: a filter here is pushed below, and makes the values twice
    leaves = None
    while True:
        for _ in range(LEVELS):
            state = _opened(state, keys)
        # What wasn't opened is a leaf or empty; only now, when it is small, is its shape asked for.
        shape = F.when(~F.col("_open"), F.schema_of_variant("_v"))
        state = state.withColumn("_shape", shape).filter(F.col("_open") | F.col("_shape").isNotNull() & ~(F.col("_shape").startswith("OBJECT") | F.col("_shape").startswith("ARRAY") | (F.lit(not nulls) & (F.col("_shape") == "VOID"))))
        whole = F.when(F.col("path") == "", "value").otherwise(F.col("path"))
        state = staged(state.select(*keys, "path", F.when(F.col("_open"), F.col("_v")).alias("_v"), "_open", whole.alias("_path"), _leaf_type(F.col("_shape")).alias("type"), F.when(~F.col("_open"), F.to_json("_v")).alias("leaf")), "slots")
        found = state.filter(~F.col("_open")).select(*keys, F.col("_path").alias("path"), "type", "leaf")
        leaves = found if leaves is None else leaves.unionByName(found)
        state = state.filter("_open").select(*keys, "path", "_v")
        if not state.limit(1).count():
            return leaves


def _opened(state: DataFrame, keys: list[str]) -> DataFrame:
    """Containers of state(*keys, path, _v) replaced by what they hold, with `_open`; other values, and empty containers, stay as they are, without."""
    opened = state.select(*keys, "path", "_v").lateralJoin(state.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
    path = F.when(F.col("key").isNull(), F.col("path")).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
    return opened.select(*keys, path.alias("path"), F.coalesce("value", "_v").alias("_v"), F.col("pos").isNotNull().alias("_open"))


def _leaf_type(shape: Column) -> Column:
    return F.when(shape == "VOID", "null").when(shape == "STRING", "str").when(shape == "BOOLEAN", "bool").when(shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int").otherwise("float")


def template(prompt: Column, values: Column, names: Column) -> Column:
    """sha256 of a prompt's tokens with its calls' argument values (`values`, an array of texts) as <arg>, and of its calls' names, in any order.

    The scan goes from the left and takes the longest value at each place; values match whole tokens. Null arrays are empty.
    """
    none = F.array().cast("array<string>")
    plain = lambda c: F.array_join(tx.tokens(c), " ")
    spelled = F.filter(F.array_distinct(F.transform(F.coalesce(values, none), plain)), lambda s: s != "")
    # The longest first, counted in tokens, so that the pattern's first alternative that fits is the longest.
    order = F.sort_array(F.transform(spelled, lambda s: F.struct((-F.size(F.split(s, " "))).alias("n"), s.alias("s"))))
    pattern = F.concat(F.lit("(?<![^ ])(?:"), F.array_join(F.transform(order, lambda o: F.concat(F.lit("\\Q"), o["s"], F.lit("\\E"))), "|"), F.lit(")(?![^ ])"))
    skeleton = F.when(F.size(spelled) > 0, F.regexp_replace(plain(prompt), pattern, F.lit("<arg>"))).otherwise(plain(prompt))
    return F.sha2(F.concat_ws("\n", skeleton, F.array_join(F.sort_array(F.coalesce(names, none)), "\x1f")), 256)


def templates(df: DataFrame, prompt: str, args: str, names: str) -> DataFrame:
    """df(id, ..., prompt, args as VARIANT, names as array) with `template` in place of these three; id is a key."""
    leaf = F.when(F.col("type") == "str", F.get_json_object(F.concat(F.lit("["), "leaf", F.lit("]")), "$[0]")).otherwise(F.col("leaf"))
    values = leaf_slots(df.select("id", args), args, nulls=True).groupBy("id").agg(F.collect_set(leaf).alias("_values"))
    j = df.drop(args).join(values.hint("merge"), "id", "left")
    return j.withColumn("template", template(F.col(prompt), F.col("_values"), F.col(names))).drop(prompt, names, "_values")
