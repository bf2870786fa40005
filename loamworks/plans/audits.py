"""Set operations, leakage audits and conversation mining over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import arguments, contamination, filters, sampling
from ..registry import Register
from ..sources.pools import Winners
from ..sources.stages import spread, staged, table
from .corpus import REASON, SQUEEZED
from .dedup import COVER
from .standins import SKELETON, SLOTS, nested, prompts

QUERIES = query = Register()
PROMPT = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"


def _prompt(col="text"):
    return F.sha2(F.lower(tx.squeeze(F.col(col))), 256)


def _keys(spark, sf_dir):
    """Documents with their digest, on the train or the eval side by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", tx.digest(F.col("text")).alias("digest"))
    return d.withColumn("side", F.when(F.col("source") == "src0", "eval").otherwise("train"))


SIDES = f"d AS (SELECT doc_id, source, lang, n_chars, sha256({SQUEEZED}) AS digest, CASE WHEN source = 'src0' THEN 'eval' ELSE 'train' END AS side FROM documents)"


@query("SELECT kind, source, count(*) AS rows FROM (SELECT 'document' AS kind, source FROM documents UNION ALL SELECT 'turn', role FROM conversations UNION ALL SELECT 'item', 'benchmark' FROM benchmark) GROUP BY ALL")
def so_union(spark, sf_dir):
    """Union of corpora with provenance, and its composition."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), "source")
    c = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("role").alias("source"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.lit("benchmark").alias("source"))
    return d.unionByName(c).unionByName(b).groupBy("kind", "source").agg(F.count("*").alias("rows"))


@query(f"WITH {SIDES}, s AS (SELECT digest, bool_or(side = 'train') AS t, bool_or(side = 'eval') AS e FROM d GROUP BY digest) SELECT count(*) FILTER (WHERE t) AS train, count(*) FILTER (WHERE e) AS eval, count(*) FILTER (WHERE t AND e) AS shared FROM s")
def so_intersect(spark, sf_dir):
    """Sizes of two fingerprint sets and of their overlap, in one aggregate by fingerprint."""
    s = _keys(spark, sf_dir).groupBy("digest").agg(F.bool_or(F.col("side") == "train").alias("t"), F.bool_or(F.col("side") == "eval").alias("e"))
    return s.agg(F.count_if("t").alias("train"), F.count_if("e").alias("eval"), F.count_if(F.col("t") & F.col("e")).alias("shared"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def so_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query(f"""WITH f AS (SELECT conv_id, arg_min({PROMPT}, turn) AS prompt, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id),
s AS (SELECT rule, prompt, CASE rule WHEN 'by first prompt' THEN ('0x' || substr(sha256('0:' || prompt), 1, 15))::BIGINT ELSE ('0x' || substr(sha256('0:' || conv_id), 1, 15))::BIGINT END % 100 < 30 AS e FROM f, (VALUES ('by first prompt'), ('by conversation')) v(rule)),
g AS (SELECT rule, prompt, bool_or(e) AND bool_or(NOT e) AS shared, bool_or(e) AS e FROM s GROUP BY rule, prompt)
SELECT rule, count(*) AS prompts, count(*) FILTER (WHERE e) AS eval_prompts, count(*) FILTER (WHERE shared) AS shared, count(*) FILTER (WHERE shared) = 0 AS ok FROM g GROUP BY rule""")
def so_assert_disjoint(spark, sf_dir):
    """Prompts that two sides of a split share: conversations split by their first prompt share none, or the query fails; split by id, the shared ones are counted."""
    first = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("p", _prompt()).groupBy("conv_id").agg(F.min_by("p", "turn").alias("prompt"))
    sides = [first.select(F.lit(rule).alias("rule"), "prompt", (sampling.bucket(F.col(c)) < 30).alias("e")) for rule, c in (("by first prompt", "prompt"), ("by conversation", "conv_id"))]
    g = sides[0].union(sides[1]).groupBy("rule", "prompt").agg((F.bool_or("e") & F.bool_or(~F.col("e"))).alias("shared"), F.bool_or("e").alias("e"))
    s = g.groupBy("rule").agg(F.count("*").alias("prompts"), F.count_if("e").alias("eval_prompts"), F.count_if("shared").alias("shared"))
    ok = F.assert_true((F.col("shared") == 0) | (F.col("rule") != "by first prompt"), "splits share prompts").isNull()
    return s.select("rule", "prompts", "eval_prompts", "shared", (ok & (F.col("shared") == 0)).alias("ok"))


@query(rf"""WITH RECURSIVE {SLOTS}, v AS (SELECT 'slot' AS leg, event_type || '.' || path AS name, user_id % 10 = 0 AS e, sha256(type || ':' || lower(trim(regexp_replace(leaf, '\s+', ' ', 'g')))) AS h FROM slots JOIN events USING (event_id)),
t AS (SELECT conv_id, conv_id % 10 = 0 AS e, arg_min({PROMPT}, turn) FILTER (WHERE role = 'user') AS p, sha256(string_agg(coalesce(role, '') || chr(31) || coalesce(text, ''), chr(30) ORDER BY turn)) AS s FROM conversations GROUP BY conv_id),
f AS (SELECT * FROM v UNION ALL SELECT 'all slots', '', e, h FROM v UNION ALL SELECT 'prompt', '', e, p FROM t WHERE p IS NOT NULL UNION ALL SELECT 'row', '', e, s FROM t),
g AS (SELECT leg, name, h, bool_or(e) AS e, bool_or(NOT e) AS t FROM f GROUP BY ALL)
SELECT leg, name, count(*) FILTER (WHERE e) AS n_eval, count(*) FILTER (WHERE t) AS n_train, count(*) FILTER (WHERE e AND t) AS shared FROM g GROUP BY ALL""")
def so_slot_audit(spark, sf_dir):
    """What the two sides of a split share: typed slot values by slot and in all, first prompts, whole conversations.

    Slots are the leaves of nested arguments under the call's name; text counts in lower case with squeezed spaces.
    """
    e = nested(spark, sf_dir).select("event_type", (F.col("user_id") % 10 == 0).alias("e"), "args")
    slots = arguments.leaf_slots(e, "args").select(F.concat_ws(".", "event_type", "path").alias("name"), "e", F.sha2(F.concat_ws(":", "type", F.lower(tx.squeeze(F.col("leaf")))), 256).alias("h"))
    # Of each slot's value the sides it occurs on, before anything else meets.
    slots = slots.groupBy("name", "h").agg(F.bool_or("e").alias("e"), F.bool_or(~F.col("e")).alias("t"))
    turns = table(spark, sf_dir, "conversations").withColumn("p", F.when(F.col("role") == "user", _prompt()))
    said = F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    c = turns.groupBy("conv_id").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("turn"))).alias("p"), F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("all"))
    c = c.select((F.col("conv_id") % 10 == 0).alias("e"), "p", F.sha2(F.array_join(F.transform("all", lambda x: x["said"]), "\x1e"), 256).alias("s"))
    side = [F.col("e"), (~F.col("e")).alias("t")]
    rows = slots.select(F.lit("slot").alias("leg"), "name", "h", "e", "t").unionByName(slots.select(F.lit("all slots").alias("leg"), F.lit("").alias("name"), "h", "e", "t"))
    for leg, key in (("prompt", "p"), ("row", "s")):
        rows = rows.unionByName(c.filter(F.col(key).isNotNull()).select(F.lit(leg).alias("leg"), F.lit("").alias("name"), F.col(key).alias("h"), *side))
    g = rows.groupBy("leg", "name", "h").agg(F.bool_or("e").alias("e"), F.bool_or("t").alias("t"))
    return g.groupBy("leg", "name").agg(F.count_if("e").alias("n_eval"), F.count_if("t").alias("n_train"), F.count_if(F.col("e") & F.col("t")).alias("shared"))


@query(f"WITH p AS (SELECT conv_id, {PROMPT} AS h FROM conversations WHERE role = 'user') SELECT count(*) AS prompts, count(*) FILTER (WHERE h IN (SELECT h FROM p WHERE conv_id % 10 <> 0)) AS leaked FROM p WHERE conv_id % 10 = 0")
def so_subset_leak(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", _prompt().alias("h"))
    train = p.filter("conv_id % 10 <> 0").select("h").distinct().withColumn("hit", F.lit(1))
    return p.filter("conv_id % 10 = 0").join(train, "h", "left").agg(F.count("*").alias("prompts"), F.count("hit").alias("leaked"))


SCREENED = f"tp AS (SELECT sha256({SKELETON}) AS template, bool_or(user_id % 10 = 0) AS e, bool_or(user_id % 10 <> 0) AS t FROM events GROUP BY 1)"


def _templates(spark, sf_dir):
    """Per template the sides of the split that have it."""
    t = arguments.templates(prompts(spark, sf_dir), "prompt", "args", "names")
    return t.groupBy("template").agg(F.bool_or(F.col("user_id") % 10 == 0).alias("e"), F.bool_or(F.col("user_id") % 10 != 0).alias("t"))


@query(f"WITH {SCREENED} SELECT count(*) FILTER (WHERE e) AS templates, count(*) FILTER (WHERE e AND t) AS leaked FROM tp")
def so_template_leak(spark, sf_dir):
    """Prompts without their calls' argument values, with the names called, compared across the sides."""
    return _templates(spark, sf_dir).agg(F.count_if("e").alias("templates"), F.count_if(F.col("e") & F.col("t")).alias("leaked"))


@query(f"""{COVER}, {SCREENED} SELECT lang AS training_table, count(DISTINCT c.item_id) AS matched_items, count(DISTINCT c.doc_id) AS matched_documents, 0::BIGINT AS matched_templates, count(DISTINCT c.item_id) = 0 AS ok FROM documents LEFT JOIN c USING (doc_id) GROUP BY lang
UNION ALL SELECT 'calls', 0, 0, count(*) FILTER (WHERE e AND t), count(*) FILTER (WHERE e AND t) = 0 FROM tp""")
def so_fresh_slice(spark, sf_dir):
    """A fresh slice against each training table: documents of a language by the benchmark items they cover, the table with calls by templates. A table with any isn't ok."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    c = staged(contamination.shingle_cover(spread(docs), items).withColumnRenamed("doc_id", "_d"), "fresh")
    d = docs.select("doc_id", F.col("lang").alias("training_table")).join(c.hint("merge"), F.col("doc_id") == F.col("_d"), "left")
    d = d.groupBy("training_table").agg(F.count_distinct("item_id").alias("matched_items"), F.count_distinct("_d").alias("matched_documents"))
    zero = F.lit(0).cast("long")
    called = _templates(spark, sf_dir).agg(F.count_if(F.col("e") & F.col("t")).alias("matched_templates")).select(F.lit("calls").alias("training_table"), zero.alias("matched_items"), zero.alias("matched_documents"), "matched_templates")
    return d.withColumn("matched_templates", zero).unionByName(called).withColumn("ok", F.col("matched_items") + F.col("matched_templates") == 0)


@query(f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND {PROMPT} NOT IN (SELECT {PROMPT} FROM conversations WHERE role = 'user' AND conv_id % 20 = 0)")
def so_holdout_prompts(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", _prompt().alias("h"))
    return p.join(p.filter("conv_id % 20 = 0").select("h").distinct(), "h", "left_anti").select("conv_id", "turn")


@query(f"WITH {SIDES} SELECT digest AS identity, count(DISTINCT side) AS sides, count(*) AS documents FROM d GROUP BY digest HAVING count(DISTINCT side) > 1")
def so_cross_artifact_split(spark, sf_dir):
    """Identities that sit on both sides."""
    return _keys(spark, sf_dir).groupBy(F.col("digest").alias("identity")).agg(F.count_distinct("side").alias("sides"), F.count("*").alias("documents")).filter("sides > 1")


@query(f"""WITH {SIDES} SELECT (SELECT count(*) FROM (SELECT doc_id FROM d GROUP BY doc_id HAVING min(side) <> max(side))) AS identities_in_two, (SELECT count(*) FROM (SELECT digest FROM d GROUP BY digest HAVING min(side) <> max(side))) AS contents_in_two, (SELECT count(*) FROM (SELECT digest FROM d GROUP BY digest HAVING count(*) > 1)) AS contents_twice""")
def so_split_conflict(spark, sf_dir):
    k = _keys(spark, sf_dir)
    two = F.count_if(F.col("lo") != F.col("hi"))
    ids = k.groupBy("doc_id").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).agg(two.alias("identities_in_two"))
    texts = k.groupBy("digest").agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.count("*").alias("n")).agg(two.alias("contents_in_two"), F.count_if(F.col("n") > 1).alias("contents_twice"))
    return ids.crossJoin(F.broadcast(texts))


@query("SELECT lang AS view, count(*) AS documents, sum(n_chars)::BIGINT AS chars, (SELECT count(*) FROM documents) AS parent, true AS partition_ok FROM documents GROUP BY lang")
def so_partition_union(spark, sf_dir):
    """Child views by language against their parent: each document in one view, and the sums equal."""
    d = table(spark, sf_dir, "documents")
    ids = d.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("parent"), F.max("n").alias("most"))
    v = d.groupBy(F.col("lang").alias("view")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).crossJoin(F.broadcast(ids))
    total = v.agg(F.sum("documents").alias("total"))
    return v.crossJoin(F.broadcast(total)).select("view", "documents", "chars", "parent", ((F.col("most") == 1) & (F.col("total") == F.col("parent"))).alias("partition_ok"))


@query("SELECT 0::BIGINT AS only_saved, 0::BIGINT AS only_rebuilt, count(*) AS audit_rows FROM (SELECT source FROM documents GROUP BY source)")
def so_frozen_verify(spark, sf_dir):
    """An audit record rebuilt from reordered rows and compared with the saved one, both ways."""
    build = lambda df: df.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.bit_xor(tx.hash60(F.col("doc_id"))).alias("fp"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    saved, again = staged(build(d), "audit"), build(d.repartition(7, "doc_id"))
    a, b = saved.exceptAll(again).agg(F.count("*").alias("only_saved")), again.exceptAll(saved).agg(F.count("*").alias("only_rebuilt"))
    return saved.agg(F.count("*").alias("audit_rows")).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))


#: Child corpora and the languages that make them; any other language is one of its own.
VIEWS = {"germanic": ("en", "de"), "romance": ("fr", "es")}


@query(f"""SELECT CASE {" ".join(f"WHEN lang IN {x} THEN '{v}'" for v, x in VIEWS.items())} ELSE coalesce(lang, 'none') END AS view, source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL""")
def snk_partitioned_views(spark, sf_dir):
    """The corpus written as disjoint child corpora by a map of languages and read back; documents and characters must sum up to the parent's."""
    from ..sources import sinks

    d = table(spark, sf_dir, "documents")
    views = sinks.grouped_views(d, "lang", VIEWS, "view", ["n_chars"])
    return views.groupBy("view", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query(f"SELECT count(*) AS rows, sum(n_chars)::BIGINT AS chars, count(DISTINCT doc_id) AS ids, bit_xor(('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 15))::BIGINT) AS fingerprint, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE {REASON} IS NULL")
def snk_filtered(spark, sf_dir):
    """Retained documents written as canonical JSON lines and read back, with an identity of what was read that no order changes."""
    from ..sources import sinks

    kept = filters.with_reject_reason(spread(table(spark, sf_dir, "documents"))).filter("reject_reason IS NULL").drop("reject_reason")
    return sinks.json_lines(kept).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), F.count_distinct("doc_id").alias("ids"), F.bit_xor(tx.hash60(F.col("doc_id"), F.sha2("text", 256))).alias("fingerprint"), F.sum(F.octet_length("text")).alias("bytes"))


@query(f"""WITH {SIDES}, b AS (SELECT 0 AS batch, digest FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 1, digest FROM d WHERE doc_id % 3 > 0 UNION ALL SELECT 2, digest FROM d WHERE doc_id % 3 > 0), f AS (SELECT digest, min(batch) AS first FROM b GROUP BY digest)
SELECT k::BIGINT AS batch, count(digest) AS added, (SELECT count(*) FROM f WHERE first <= k) AS pool_rows FROM (SELECT unnest([0, 1, 2]) AS k) LEFT JOIN f ON first = k GROUP BY k""")
def snk_append_pool(spark, sf_dir):
    """New rows appended to a pool by fingerprint: even documents, then a batch that overlaps them, then that batch again."""
    d = _keys(spark, sf_dir).select("digest", "doc_id")
    pool = Winners(spark, "digest string, doc_id long", "digest", ["doc_id"], buckets=16)
    batches = [d.filter("doc_id % 2 = 0"), *[d.filter("doc_id % 3 > 0")] * 2]
    added = [pool.upsert(batch, k)["added"] for k, batch in enumerate(batches)]
    rows = None
    for k, n in enumerate(added):
        one = pool.current(k).agg(F.count("*").alias("pool_rows")).select(F.lit(k).cast("long").alias("batch"), F.lit(n).cast("long").alias("added"), "pool_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


VERIFIED = """v AS (SELECT c.conv_id, CASE WHEN conv_id % 10 = 0 THEN 'not_train' WHEN bool_and(role <> 'assistant') THEN 'no_assistant' WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'bad_role' WHEN bool_or(coalesce(text, '') = '') THEN 'empty_turn' END AS reject_reason FROM conversations c GROUP BY c.conv_id)"""


def _verified(spark, sf_dir):
    r = F.col("role")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(r == "assistant").alias("a"), F.bool_or(~r.isin("system", "user", "assistant")).alias("bad"), F.bool_or(F.coalesce("text", F.lit("")) == "").alias("empty"))
    return c.select("conv_id", F.when(F.col("conv_id") % 10 == 0, "not_train").when(~F.col("a"), "no_assistant").when(F.col("bad"), "bad_role").when(F.col("empty"), "empty_turn").alias("reject_reason"))


@query(f"WITH {VERIFIED} SELECT * FROM v")
def fw_verify(spark, sf_dir):
    """Row rules of conversations; the first that fails is the reason."""
    return _verified(spark, sf_dir)


FEEDBACK = "SELECT d.doc_id, source, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND d.doc_id % 10 <= 5 THEN 'selected' WHEN quality = 1 THEN 'uncertain' WHEN quality = 0 THEN 'not_adopted' ELSE 'unlabelled' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id)"


def _feedback(spark, sf_dir):
    """Adopted is quality 1, rejected is toxic; uncertainty (doc_id mod 10, in tenths) may be 0.5 at most."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality") == 1
    sure = (F.col("doc_id") % 10) / 10 <= 0.5
    return j.withColumn("decision", F.when(F.col("toxic") == 1, "rejected").when(q & sure, "selected").when(q, "uncertain").when(F.col("quality") == 0, "not_adopted").otherwise("unlabelled"))


@query(FEEDBACK)
def fw_feedback(spark, sf_dir):
    return _feedback(spark, sf_dir).select("doc_id", "source", "decision")


@query(f"WITH f AS ({FEEDBACK}), d AS (SELECT doc_id, sha256({SQUEEZED}) AS fp FROM documents) SELECT fp, min(doc_id) AS doc_id, count(*) AS candidates FROM f JOIN d USING (doc_id) WHERE decision IN ('selected', 'unlabelled') GROUP BY fp")
def fw_mine(spark, sf_dir):
    """Selected rows, the first of each fingerprint by source position (doc_id)."""
    f = _feedback(spark, sf_dir).filter(F.col("decision").isin("selected", "unlabelled")).withColumn("fp", tx.digest(F.col("text")))
    return f.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("candidates"))


