"""Packing, rendering, masking and page text over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import arguments, rendering
from ..registry import Register
from ..sources.stages import table
from .corpus import TOKENS
from .standins import SLOTS, nested

QUERIES = query = Register()
ROW = 2048
PACK = f"""o AS (SELECT doc_id, octet_length(encode(text)) + 1 AS n, coalesce(sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM documents),
pk AS (SELECT doc_id, r AS row, greatest(f, r * {ROW}) - r * {ROW} AS start, least(f + n, (r + 1) * {ROW}) - greatest(f, r * {ROW}) AS tokens FROM (SELECT *, unnest(generate_series(f // {ROW}, (f + n - 1) // {ROW})) AS r FROM o))"""


def _packed(spark, sf_dir):
    return rendering.pack(table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n")), ["doc_id"], F.col("n"), ROW)


@query(f"WITH {PACK} SELECT doc_id, row, start, tokens FROM pk")
def tx_pack(spark, sf_dir):
    """Byte tokens and an end token per document, in rows of 2,048."""
    return _packed(spark, sf_dir)


@query(f"WITH {PACK}, r AS (SELECT row, sum(tokens)::BIGINT AS t, count(*) AS pieces FROM pk GROUP BY row) SELECT count(*) AS rows, sum(t)::BIGINT AS tokens, round(sum(t) / (count(*) * {ROW}), 6) AS fill, max(pieces) AS most_pieces, count(*) FILTER (WHERE t = {ROW}) AS full_rows FROM r")
def tx_pack_stats(spark, sf_dir):
    r = _packed(spark, sf_dir).groupBy("row").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"))
    return r.agg(F.count("*").alias("rows"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * ROW), 6).alias("fill"), F.max("pieces").alias("most_pieces"), F.count_if(F.col("t") == ROW).alias("full_rows"))


@query(f"SELECT conv_id, turn, octet_length(encode(text)) AS byte_tokens, len({TOKENS}) AS word_tokens FROM conversations")
def tx_token_lengths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("byte_tokens"), F.size(tx.tokens(F.col("text"))).cast("long").alias("word_tokens"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def tx_render(spark, sf_dir):
    return rendering.render(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, sha256(h) AS prompt_sha FROM (SELECT conv_id, turn, role, coalesce(string_agg('<|' || role || '|>' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS h FROM conversations) WHERE role = 'assistant'")
def tx_prompts(spark, sf_dir):
    """Hashes of all decode prefixes."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    h = F.array_join(F.collect_list(F.concat(F.lit("<|"), "role", F.lit("|>"), "text")).over(w), "\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2(h, 256).alias("prompt_sha")).filter("role = 'assistant'").drop("role")


@query("""WITH n AS (SELECT DISTINCT user_id, event_type FROM events), a AS (SELECT user_id, event_type, 'fn_' || row_number() OVER (PARTITION BY user_id ORDER BY sha256(user_id || ':' || event_type), event_type) AS alias FROM n)
SELECT event_id, event_type AS name, 'original' AS variant FROM events UNION ALL SELECT event_id, alias, 'masked' FROM events JOIN a USING (user_id, event_type)""")
def tx_mask_names(spark, sf_dir):
    """Names replaced by per-group aliases, in union with the originals."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    a = rendering.aliases(e, "user_id", "event_type", "fn_")
    masked = e.join(a, ["user_id", "event_type"]).select("event_id", F.col("alias").alias("name"), F.lit("masked").alias("variant"))
    return e.select("event_id", F.col("event_type").alias("name"), F.lit("original").alias("variant")).union(masked)


@query("""WITH t AS (SELECT DISTINCT p_brand AS tool FROM part), u AS (SELECT DISTINCT l_orderkey AS k, p_brand AS tool FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT k, t.tool, u2.tool IS NOT NULL AS used, row_number() OVER (PARTITION BY k ORDER BY (u2.tool IS NULL)::INT, sha256(k || ':' || t.tool), t.tool) AS i FROM (SELECT DISTINCT k FROM u) CROSS JOIN t LEFT JOIN u u2 USING (k, tool))
SELECT k AS row_id, string_agg(tool, ',' ORDER BY tool) AS catalog, count(*) FILTER (WHERE used) AS used FROM c WHERE i <= 12 GROUP BY k""")
def tx_attach_catalog(spark, sf_dir):
    """Rows get the tools they use and seeded distractors up to twelve. The catalogue is the set of brands, of bounded size."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("tool"))
    used = l.join(p, "p_partkey").groupBy("k").agg(F.collect_set("tool").alias("mine"))
    tools = p.agg(F.array_sort(F.collect_set("tool")).alias("all"))
    j = used.crossJoin(F.broadcast(tools))  # one row
    order = F.array_sort(F.transform(F.array_except("all", "mine"), lambda t: F.struct(F.sha2(F.concat_ws(":", F.col("k").cast("string"), t), 256).alias("h"), t.alias("t"))))
    mine = F.array_sort(F.transform("mine", lambda t: F.struct(F.sha2(F.concat_ws(":", F.col("k").cast("string"), t), 256).alias("h"), t.alias("t"))))
    top = F.slice(F.concat(mine, order), 1, 12)
    return j.select(F.col("k").alias("row_id"), F.array_join(F.array_sort(F.transform(top, lambda x: x["t"])), ",").alias("catalog"), F.least(F.size("mine"), F.lit(12)).cast("long").alias("used"))


@query("SELECT event_type AS name, string_agg(DISTINCT key, ',' ORDER BY key) AS keys, count(DISTINCT event_id) AS calls FROM (SELECT event_id, event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY event_type")
def tx_suite_catalog(spark, sf_dir):
    """A catalogue from observed calls: argument names per name."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"), F.count_distinct("event_id").alias("calls"))


@query("""WITH f AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') AS first FROM conversations GROUP BY conv_id)
SELECT c.conv_id, any_value(first) AS turn, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn < first) AS before FROM conversations c JOIN f USING (conv_id) WHERE first IS NOT NULL GROUP BY c.conv_id""")
def tx_task(spark, sf_dir):
    """The first call (assistant turn) and all text before it."""
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("turn")).filter("turn IS NOT NULL")
    before = F.filter("m", lambda x: x["turn"] < F.col("turn"))
    return m.select("conv_id", "turn", F.when(F.size(before) > 0, F.array_join(F.transform(before, lambda x: x["text"]), "\n")).alias("before"))




@query("""WITH p AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' AND conv_id % 10 <> 0 GROUP BY conv_id), l AS (SELECT unnest([1, 2, 3]) AS level)
SELECT conv_id, level::BIGINT AS level, replace(['Please help: {}', 'Could you handle this: {}', 'Task: {}'][1 + (('0x' || substr(sha256(conv_id || ':' || level), 1, 15))::BIGINT % 3)], '{}', CASE level WHEN 2 THEN 'in context, ' || prompt WHEN 3 THEN 'cancelled, ' || prompt ELSE prompt END) AS text FROM p, l""")
def tx_enrich(spark, sf_dir):
    """Derived training rows: wrapper, context wrapper and cancelled counterfactual, the template chosen by a stable hash."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user' AND conv_id % 10 <> 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    r = c.select("conv_id", "prompt", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("level"))
    form = F.element_at(F.array(F.lit("Please help: {}"), F.lit("Could you handle this: {}"), F.lit("Task: {}")), (tx.hash60(F.col("conv_id"), F.col("level")) % 3 + 1).cast("int"))
    body = F.when(F.col("level") == 2, F.concat(F.lit("in context, "), "prompt")).when(F.col("level") == 3, F.concat(F.lit("cancelled, "), "prompt")).otherwise(F.col("prompt"))
    return r.select("conv_id", "level", F.replace(form, F.lit("{}"), body).alias("text"))


_ARGS = """concat('{"a":[1,{"b":"', event_type, '"}],"user":', user_id, '}')"""
#: Texts with calls made from events, by event_id % 8, and what each holds: a nested object in prose; two calls; calls inside another object; arguments as text;
#: a broken object and a bare name; name(key=value) with quotes and nesting; a broken object and a whole one; none.
_TEXTS = (
    (f"""concat('I will run {{"name": "', event_type, '", "arguments": ', {_ARGS}, '}} now')""", 1, "event_type", _ARGS, "'json'", 0),
    (f"""concat('{{"tool": "first", "args": {{}}}} then {{"function": "', event_type, '", "parameters": ', {_ARGS}, '}}')""", 2, "'first'", "'{}'", "'json'", 0),
    (f"""concat('{{"tool_calls": [{{"name": "', event_type, '", "arguments": ', {_ARGS}, '}}, {{"name": "second"}}]}}')""", 2, "event_type", _ARGS, "'json'", 0),
    (f"""concat('{{"name": "', event_type, '", "arguments": "', replace({_ARGS}, '"', concat(chr(92), '"')), '"}}')""", 1, "event_type", _ARGS, "'json'", 0),
    ("""concat('{"name": "', event_type, '", "arguments": {oops}}')""", 1, "event_type", "'{}'", "'name'", 1),
    ("""concat('[', event_type, '(user=', user_id, ', tags=["a", (1)], who="x, (y)", on=True, "last")]')""", 1, "event_type", """concat('{"4":"last","on":true,"tags":"[', chr(92), '"a', chr(92), '", (1)]","user":', user_id, ',"who":"x, (y)"}')""", "'plain'", 0),
    (f"""concat('{{bad}} and "{{" {{"name": "', event_type, '", "arguments": ', {_ARGS}, '}}')""", 1, "event_type", _ARGS, "'json'", 1),
    ("'nothing to call'", 0, "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", 0),
)


def _by_text(place: int) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {t[place]}" for i, t in enumerate(_TEXTS)) + " END"


@query(f"SELECT event_id, {_by_text(1)}::BIGINT AS calls, {_by_text(2)} AS name, {_by_text(3)} AS args, {_by_text(4)} AS kind, {_by_text(5)}::BIGINT AS failures FROM events".replace("AS STRING", "AS VARCHAR"))
def tx_parse_calls(spark, sf_dir):
    """Calls read out of free text: how many, the first one's name, arguments and spelling, and the objects that aren't JSON."""
    c = table(spark, sf_dir, "events").select("event_id", arguments.parse_calls(F.expr(_by_text(0))).alias("c"))
    first = F.get("c.calls", F.lit(0))
    return c.select("event_id", F.size("c.calls").cast("long").alias("calls"), first["name"].alias("name"), first["args"].alias("args"), first["kind"].alias("kind"), F.col("c.failures").cast("long").alias("failures"))


@query()
def tx_dom_rank(spark, sf_dir):
    """Page elements within 2,000 bytes for the page's title as the task."""
    pages = table(spark, sf_dir, "pages")
    return rendering.rank_nodes(rendering.page_nodes(pages), pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("task")), 2000)


@query()
def tx_page_text(spark, sf_dir):
    return rendering.page_text(table(spark, sf_dir, "pages"), 20_000)


@query(f"WITH RECURSIVE {SLOTS} SELECT event_id, path, type, leaf FROM slots")
def tx_slot_values(spark, sf_dir):
    """Leaf (path, type, value) rows of nested arguments."""
    return arguments.leaf_slots(nested(spark, sf_dir).select("event_id", "args"), "args")
