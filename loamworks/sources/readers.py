"""Readers of raw corpora: JSON lines, text files, sampled folders, function-calling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest record in bytes, and the suffixes of files that are a document each.
MAX_BYTES = 8 * 1024 * 1024
TEXT_SUFFIXES = "txt md rst py js ts java rs go".split()
RECORD = "doc_id string, id string, source string, license string, text string, content string, code string, meta map<string,string>, _bad string"
CALLS = "array<struct<name: string, arguments: string>>"


def json_lines(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A document a line: doc_id, source, license, text, meta, state, bytes. Blank lines are skipped.

    state is 'ok', 'oversize' (a line over max_bytes), 'malformed' (no JSON object) or 'no_text' (none of text, content and
    code is a string). Only rows that are 'ok' have a text, so that what is refused can be counted or kept apart.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(~F.col("value").rlike(r"^\s*$"))
    size = F.octet_length("value")
    r = lines.select("file", size.alias("bytes"), F.when(size <= max_bytes, F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).alias("r"))
    text = F.coalesce("r.text", "r.content", "r.code")
    state = F.when(F.col("bytes") > max_bytes, "oversize").when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed").when(text.isNull(), "no_text").otherwise("ok")
    r = r.withColumn("state", state)
    return r.select(
        F.coalesce("r.doc_id", "r.id").alias("doc_id"), F.coalesce("r.source", "file").alias("source"), F.coalesce("r.license", F.lit("unknown")).alias("license"),
        F.when(F.col("state") == "ok", text).alias("text"), F.coalesce("r.meta", F.create_map().cast("map<string,string>")).alias("meta"), "state", "bytes",
    )


def text_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, suffixes: list[str] | None = None) -> DataFrame:
    """A document a file, of the given suffixes below a folder: doc_id (the path), source, license, text. Larger files fail the job, before they are read."""
    glob = "*.{" + ",".join(suffixes or TEXT_SUFFIXES) + "}"
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    f = files.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("bytes"), "value")
    text = F.when(F.col("bytes") <= max_bytes, F.col("value")).otherwise(F.raise_error(F.concat("source", F.lit(f": document exceeds {max_bytes} bytes"))))
    return f.select(F.col("source").alias("doc_id"), "source", F.lit("unknown").alias("license"), text.alias("text"))


def identified(docs: DataFrame) -> DataFrame:
    """docs with a stable doc_id: the one given, unless it is empty or a file's path; else the sha256 of the text."""
    given = F.when(~F.col("doc_id").startswith("file:"), F.nullif(F.col("doc_id"), F.lit("")))
    return docs.withColumn("doc_id", F.coalesce(given, F.sha2("text", 256)))


def within(docs: DataFrame, max_bytes: int) -> DataFrame:
    return docs.filter(F.octet_length("text") <= max_bytes)


def sample_folders(spark: SparkSession, base: str, k: int, seed: int) -> list[str]:
    """k folders of files below base, the first by sha256 of "seed:relative path". Only names are read; k names return."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = files.select(folder.alias("folder")).distinct().withColumn("name", F.regexp_replace("folder", "^.*" + base.rstrip("/").split("/")[-1] + "/", ""))
    return [r.folder for r in rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "name"), 256), "name").limit(k).collect()]


def function_calls(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(row_id, query, tools, answers), the last two JSON strings -> (conversations, quarantine).

    A conversation is row_id, tools (sorted by name), and messages: the user's query and the assistant's calls. A row without
    a query, a tool or a call, or with a call whose arguments are no object, goes to the quarantine as it was, with a reason.
    """
    r = raw.withColumns({"_t": F.from_json("tools", "array<struct<name: string, description: string, parameters: string>>"), "_c": F.from_json("answers", CALLS), "_ok": F.try_parse_json("answers").isNotNull()})
    named = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) & F.forall(c, lambda x: F.coalesce(x["name"] != "", F.lit(False)))
    objects = F.forall("_c", lambda x: F.coalesce(x["arguments"], F.lit("{}")).startswith("{"))
    reason = F.when(F.coalesce("query", F.lit("")) == "", "query").when(~named("_t"), "tools").when(~F.col("_ok") | ~named("_c") | ~objects, "answers")
    r = r.withColumn("reason", reason)
    calls = F.transform("_c", lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["arguments"], F.lit("{}")).alias("arguments")))
    none = F.lit(None)
    user = F.struct(F.lit("user").alias("role"), F.col("query").alias("content"), none.cast(CALLS).alias("tool_calls"))
    reply = F.struct(F.lit("assistant").alias("role"), none.cast("string").alias("content"), calls.alias("tool_calls"))
    good = r.filter("reason IS NULL").select("row_id", F.array_sort("_t").alias("tools"), F.array(user, reply).alias("messages"))
    return good, r.filter("reason IS NOT NULL").select(*raw.columns, "reason")
