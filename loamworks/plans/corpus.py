"""Sources, document filters and projections over the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filters
from ..registry import Register
from ..sources.stages import shared_dir, spread, staged, table

QUERIES = query = Register()

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: SQL of the stripped text, its squeezed form, and a text's long lower-cased lines.
CLEAN = f"trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {WS})"
SQUEEZED = rf"trim(regexp_replace(text, '\s+', ' ', 'g'))"
LINES = rf"[y for y in [lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) for x in string_split({CLEAN}, chr(10))] if length(y) >= 20]"
REPETITION = f"CASE WHEN len({LINES}) > 0 THEN 1 - len(list_distinct({LINES})) / len({LINES}) ELSE 0 END"
REASON = f"""CASE WHEN length(text) > 2000000 THEN 'too_long' WHEN length({CLEAN}) < 200 THEN 'too_short'
  WHEN length({CLEAN}) - length(regexp_replace({CLEAN}, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')) > 0.01 * length({CLEAN}) THEN 'control_characters'
  WHEN length({CLEAN}) - length(replace({CLEAN}, chr(65533), '')) > 0.001 * length({CLEAN}) THEN 'replacement_characters'
  WHEN {REPETITION} > 0.35 THEN 'repetitive' END"""
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query("""SELECT coalesce(doc_id::VARCHAR, sha256(text)) AS doc_id, source, length(text) AS chars FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) <= 20000
UNION ALL SELECT sha256(text), 'benchmark/' || item_id, length(text) FROM benchmark WHERE octet_length(encode(text)) <= 20000""")
def src_documents(spark, sf_dir):
    """The corpus as JSON lines beside the benchmark as text files, read back by the readers; records over 20,000 bytes of text are refused."""
    from ..sources import readers

    base = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    d = docs(spark, sf_dir).filter("text IS NOT NULL")
    blank = F.when(F.col("doc_id") % 5 == 0, "  ")  # blank lines, which the reader skips
    lines = d.select(F.explode(F.array_compact(F.array(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")), blank))).alias("value"))
    lines.write.text(f"{base}/lines")
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\x00").text(f"{base}/files")
    a = readers.json_lines(spark, f"{base}/lines")
    b = readers.text_files(spark, f"{base}/files")
    b = b.withColumn("source", F.concat(F.lit("benchmark/"), F.regexp_extract("source", "item_id=([0-9]+)", 1))).withColumn("text", F.rtrim(F.col("text"), F.lit("\x00")))
    both = readers.identified(a.filter("state = 'ok'").select("doc_id", "source", "text").unionByName(b.select("doc_id", "source", "text")))
    return readers.within(both, 20_000).select("doc_id", "source", F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 7 <> 0 THEN doc_id::VARCHAR END, sha256(text)) AS stable_id FROM documents")
def src_stable_id(spark, sf_dir):
    """Upstream ids (taken away from every seventh document here), else the text's sha256."""
    given = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(F.nullif(given, F.lit("")), F.sha2("text", 256)).alias("stable_id"))


@query("SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM documents")
def src_parquet_project(spark, sf_dir):
    """Only the text column is read."""
    return docs(spark, sf_dir).select("text").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""WITH p AS (SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source) SELECT * FROM p ORDER BY sha256('2026:source=' || source), source LIMIT 5""")
def src_file_sample(spark, sf_dir):
    """A deterministic subset of files: the corpus is written as a folder a source, five folders are taken by seeded hash of their paths, and only these are read."""
    from ..sources import readers

    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    docs(spark, sf_dir).select("doc_id", "n_chars", "source").write.partitionBy("source").parquet(base)
    paths = readers.sample_folders(spark, base, 5, 2026)
    return spark.read.option("basePath", base).parquet(*paths).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query(rf"SELECT min(item_id) AS item_id, lower({SQUEEZED}) AS prompt, count(*) AS entries FROM benchmark WHERE octet_length(encode(text)) <= 65536 GROUP BY lower({SQUEEZED})")
def src_denylist(spark, sf_dir):
    """Evaluation prompts by comparison form, entries over the byte cap left out."""
    b = table(spark, sf_dir, "benchmark").filter(F.octet_length("text") <= 65_536)
    return b.groupBy(tx.canonical_prompt(F.col("text")).alias("prompt")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("entries"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def src_conversations(spark, sf_dir):
    """Conversations as ordered arrays of turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("n")))).alias("m"))
    return c.select("conv_id", F.size("m").cast("long").alias("turns"), F.array_join("m.role", ">").alias("roles"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("chars"))


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 97 = 0 THEN left(props, length(props) - 1) ELSE props END AS arguments FROM events)
SELECT event_id, CASE WHEN json_valid(arguments) THEN 'ok' ELSE 'quarantined' END AS state, CASE WHEN json_valid(arguments) THEN 'user>assistant' END AS roles, CASE WHEN json_valid(arguments) THEN event_type END AS tool, CASE WHEN json_valid(arguments) THEN json_extract_string(arguments, '$.k') END AS k FROM e""")
def src_function_call_rows(spark, sf_dir):
    """Function-calling rows of JSON strings (query, tools, answers) to conversations; rows that don't parse go to a quarantine table. Every 97th row is broken here."""
    from ..sources import readers

    e = table(spark, sf_dir, "events")
    arguments = F.when(F.col("event_id") % 97 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    raw = e.select(
        F.col("event_id").alias("row_id"), F.concat(F.lit("What did "), F.col("user_id"), F.lit(" do?")).alias("query"), F.to_json(F.array(F.struct(F.col("event_type").alias("name")))).alias("tools"),
        F.concat(F.lit('[{"name":"'), F.col("event_type"), F.lit('","arguments":'), arguments, F.lit("}]")).alias("answers"),
    )
    good, bad = readers.function_calls(raw)
    ok = good.select(F.col("row_id").alias("event_id"), F.lit("ok").alias("state"), F.array_join("messages.role", ">").alias("roles"), F.col("messages")[1]["tool_calls"][0]["name"].alias("tool"), F.get_json_object(F.col("messages")[1]["tool_calls"][0]["arguments"], "$.k").alias("k"))
    none = F.lit(None).cast("string")
    return ok.union(bad.select(F.col("row_id"), F.lit("quarantined"), none, none, none))


@query("""SELECT user_id, event_id, step, event_type, least(total, 5) AS kept_steps FROM (
  SELECT user_id, event_id, event_type, row_number() OVER w AS step, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE step <= 5""")
def src_web_action_rows(spark, sf_dir):
    """Action lists per task, capped to five steps, one row a step. Later steps are pruned before the shuffle."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    total = e.groupBy(F.col("user_id").alias("_user")).agg(F.least(F.count("*"), F.lit(5)).cast("long").alias("kept_steps"))
    steps = e.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("step <= 5")
    return steps.join(total.hint("merge"), F.col("user_id").eqNullSafe(F.col("_user"))).select("user_id", "event_id", F.col("step").cast("long").alias("step"), "event_type", "kept_steps")


@query("SELECT user_id, count(*) AS steps, string_agg(event_type, ' ' ORDER BY ts, event_id) AS actions, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def src_trajectory_rows(spark, sf_dir):
    """Step rows gathered into one row per episode."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("user_id", F.size("s").cast("long").alias("steps"), F.array_join("s.event_type", " ").alias("actions"), "total")


@query(f"SELECT doc_id, length({CLEAN}) AS chars, {REASON} AS reject_reason FROM documents")
def flt_quality(spark, sf_dir):
    return filters.with_reject_reason(docs(spark, sf_dir)).select("doc_id", F.length(tx.unix_lines(F.col("text"))).cast("long").alias("chars"), "reject_reason")


@query(f"SELECT coalesce({REASON}, 'passed') AS outcome, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def flt_quality_counts(spark, sf_dir):
    d = filters.with_reject_reason(docs(spark, sf_dir)).select(F.coalesce("reject_reason", F.lit("passed")).alias("outcome"), "n_chars")
    return d.groupBy("outcome").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query(f"SELECT doc_id, round({REPETITION}, 6) AS repetition FROM documents")
def prj_repetition(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", tx.long_lines(tx.unix_lines(F.col("text"))).alias("lines"))
    return d.select("doc_id", F.round(tx.repeated_share(F.col("lines")), 6).alias("repetition"))


@query(r"SELECT doc_id, round((length(text) - length(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'))) / greatest(length(text), 1), 6) AS control_ratio FROM documents")
def prj_control_ratio(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.round(tx.controls(t) / F.greatest(F.length(t), F.lit(1)), 6).alias("control_ratio"))


@query(f"SELECT doc_id, sha256({SQUEEZED}) AS digest FROM documents")
def prj_normalized_digest(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.digest(F.col("text")).alias("digest"))


@query(f"SELECT doc_id, len({TOKENS}) AS tokens, len(list_distinct({TOKENS})) AS distinct_tokens, {TOKENS}[1] AS first_token FROM documents")
def prj_tokens(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
s AS (SELECT doc_id, unnest([array_to_string(t[i:i + 4], ' ') for i in generate_series(1, greatest(len(t) - 4, 1))]) AS s FROM t WHERE len(t) > 0)
SELECT t.doc_id, count(DISTINCT s) AS shingles, min(sha256(s)) AS least FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id""")
def prj_shingles(spark, sf_dir):
    """Distinct five-token shingles of whole texts, and the least of their hashes."""
    d = tx.with_shingles(docs(spark, sf_dir).select("doc_id", "text"), 5)
    return d.select("doc_id", F.size("s").cast("long").alias("shingles"), F.array_min(F.transform("s", lambda x: F.sha2(x, 256))).alias("least"))


CODE = r"""cl AS (SELECT doc_id, regexp_matches(source, '(?i)[^/]\.(c|cc|cpp|cs|css|go|h|hpp|html|java|js|jsx|kt|php|py|rb|rs|sh|sql|swift|ts|tsx|vue)$') OR regexp_matches(lower(source), 'codeparrot|github|starcoder|the-stack|source-code') OR
  (regexp_matches(t, '(?m)^\s*(def|class|import|from|function|interface)\s+\w+')::INT + regexp_matches(t, '(?m)^\s*(const|let|var)\s+\w+\s*=')::INT
  + regexp_matches(t, '(?m)[{};]\s*(//.*)?$')::INT + regexp_matches(t, '(?m)^\s*#(include|define|!/)')::INT) >= 2 AS code_like FROM (SELECT doc_id, source, text[:16384] AS t FROM documents))"""


@query(f"WITH {CODE} SELECT doc_id, code_like FROM cl")
def flt_code_like(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", filters.code_like(F.col("text"), F.col("source")).alias("code_like"))


@query("SELECT lower(trim(coalesce(lang, 'unknown'))) AS license, lower(trim(coalesce(lang, 'unknown'))) IN ('en', 'fr') AS allowed, count(*) AS documents FROM documents GROUP BY 1, 2")
def flt_license(spark, sf_dir):
    """Licences (lang stands in) against an allowlist; the others are counted as skipped."""
    d = docs(spark, sf_dir).select(F.lower(F.trim(F.coalesce("lang", F.lit("unknown")))).alias("license"))
    return d.withColumn("allowed", F.col("license").isin("en", "fr")).groupBy("license", "allowed").agg(F.count("*").alias("documents"))


@query(r"SELECT page_id, 'web:' || regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS family FROM pages")
def prj_source_family(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", filters.source_family(F.col("url")).alias("family"))


# RE2 has no lookaround, so the SQL tests the character before and after with groups. Its case folding and its white space aren't
# Java's: A-Z are made small first, and white space is spelled out. Card numbers may follow each other, or other digits, with one
# space between, so a group behind them would take what the next one begins with: every run of digits is put in angle brackets, which
# are where numbers may begin and end.
SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
EMAIL_SQL = r"(^|[^a-z0-9._%+-])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}($|[^a-z0-9.-])"
CARDS = r"[regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(regexp_replace(text, '([0-9]+)', '<\1>', 'g'), '<[0-9](?:(?:>[ -]<)?[0-9]){12,18}>')]"
LUHN = "[x for x in {c} if list_sum([CASE WHEN (length(x) - i) % 2 = 1 THEN (CASE WHEN x[i]::INT > 4 THEN x[i]::INT * 2 - 9 ELSE x[i]::INT * 2 END) ELSE x[i]::INT END for i in generate_series(1, length(x))]) % 10 = 0 AND length(replace(x, x[1], '')) > 0]"


def _re2(pattern: str) -> str:
    return pattern.removeprefix("(?i)").replace(r"[^\s", r"[^ \t\n\x0B\f\r").replace(r"\s", r"[ \t\n\x0B\f\r]").replace("'", "''")


PHONE_SQL = _re2(filters.PHONE)
SECRET_SQL = _re2(filters.SECRET)
REASONS = ("email", "labeled_phone", "labeled_secret", "payment_card", "ssn")
FLAGS = rf"""regexp_matches({SMALL}, '{EMAIL_SQL}') AS email, regexp_matches({SMALL}, '{PHONE_SQL}') AS labeled_phone, regexp_matches({SMALL}, '{SECRET_SQL}') AS labeled_secret,
  len({LUHN.replace("{c}", CARDS)}) > 0 AS payment_card, regexp_matches(text, '(^|[^0-9])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}($|[^0-9])') AS ssn"""


@query(f"SELECT doc_id, {FLAGS} FROM documents")
def flt_privacy(spark, sf_dir):
    """Personal data per document, as a flag for each reason."""
    d = docs(spark, sf_dir).select("doc_id", filters.privacy_reasons(F.col("text")).alias("r"))
    return d.select("doc_id", *[F.array_contains("r", k).alias(k) for k in REASONS])


@query(f"""WITH r AS (SELECT doc_id, source || ':' || (doc_id % 50) AS grp, {FLAGS} FROM documents), g AS (SELECT grp, count(*) AS documents, {", ".join(f"count(*) FILTER (WHERE {k}) AS {k}" for k in REASONS)}, bool_or(coalesce({" OR ".join(REASONS)}, false)) AS excluded FROM r GROUP BY grp)
SELECT *, CASE WHEN excluded THEN 0 ELSE documents END AS retained FROM g""")
def flt_privacy_group(spark, sf_dir):
    """Whole groups (a source's documents with one remainder of doc_id by 50) go when any of their rows has a reason; rows and reasons of each group are counted.

    A null text has no reason; documents without a source are a group.
    """
    grp = F.concat(F.col("source"), F.lit(":"), F.col("doc_id") % 50)
    d = staged(docs(spark, sf_dir).select(grp.alias("grp"), filters.privacy_reasons(F.col("text")).alias("r")), "reasons")
    counts = d.groupBy("grp").agg(F.count("*").alias("documents"), *[F.count_if(F.array_contains("r", k)).alias(k) for k in REASONS], F.bool_or(F.size("r") > 0).alias("excluded"))
    kept = filters.exclude_groups(d, "grp", F.col("r")).groupBy(F.col("grp").alias("_grp")).agg(F.count("*").alias("n"))
    return counts.join(kept.hint("merge"), F.col("grp").eqNullSafe(F.col("_grp")), "left").select("grp", "documents", *REASONS, "excluded", F.coalesce("n", F.lit(0)).alias("retained"))


@query(rf"SELECT item_id, lower({SQUEEZED}) AS prompt FROM benchmark")
def prj_canonical_holdout(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.canonical_prompt(F.col("text")).alias("prompt"))


@query(rf"""WITH c AS (SELECT conv_id, sum(len({TOKENS}) + 3)::BIGINT AS n FROM conversations GROUP BY conv_id)
SELECT count(*) AS conversations, round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens, count(*) FILTER (WHERE n > 512) AS over_limit, round(avg((n > 512)::INT), 6) AS over_share FROM c""")
def flt_fits_context(spark, sf_dir):
    """Rendered lengths (tokens and three marks a turn) against a context of 512."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.size(tx.tokens(F.col("text"))) + 3).alias("n"))
    over = F.col("n") > 512
    return c.agg(F.count("*").alias("conversations"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("n").alias("max_tokens"), F.count_if(over).alias("over_limit"), F.round(F.avg(over.cast("int")), 6).alias("over_share"))


@query("SELECT p_partkey, p_brand, p_size <= 25 AS trainable FROM part WHERE p_type LIKE '%BRASS%' OR p_size <= 25")
def flt_trainable(spark, sf_dir):
    """Catalogue rows by policy: small parts may train, and brass ones are listed in any case."""
    p = table(spark, sf_dir, "part")
    return p.filter(F.col("p_type").contains("BRASS") | (F.col("p_size") <= 25)).select("p_partkey", "p_brand", (F.col("p_size") <= 25).alias("trainable"))


@query(f"""WITH q AS (SELECT doc_id, lang, source, n_chars, {SQUEEZED} AS t FROM documents WHERE {REASON} IS NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY sha256(t) ORDER BY doc_id) AS k FROM q),
c AS (SELECT * FROM d WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(d.t), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))))),
r AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS pos, count(*) OVER () AS n FROM c)
SELECT lang, CASE WHEN pos <= least(greatest(round_even(n * 0.01, 0), 1), n - 1) THEN 'validation' ELSE 'train' END AS split, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM r GROUP BY 1, 2""")
def corpus_by_split(spark, sf_dir):
    """The flagship: quality rules, exact deduplication, benchmark screen, exact-count split; documents and characters per language."""
    from ..operators import contamination, dedup, sampling

    d = filters.with_reject_reason(docs(spark, sf_dir)).filter("reject_reason IS NULL")
    d = staged(d.select("doc_id", "lang", "n_chars", tx.squeeze(F.col("text")).alias("t")).withColumn("digest", F.sha2("t", 256)), "passed")  # texts are worked on once
    d = dedup.exact_winners(d, ["doc_id"]).withColumn("t", F.lower("t"))
    d = staged(contamination.without_contained(d, table(spark, sf_dir, "benchmark").select(F.lower(tx.squeeze(F.col("text"))).alias("entry"))).select("doc_id", "lang", "n_chars"), "screened")
    d = sampling.exact_split(d, "doc_id", 0.01, 7)
    return d.groupBy("lang", "split").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))



