"""Windows, ranks, orders, splits and samples over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ranks import global_rank, rank_within
from ..operators import ordering, sampling
from ..operators.retrieval import ngram_topk
from ..registry import Register
from ..sources.stages import spread, staged, table
from .corpus import SQUEEZED

QUERIES = query = Register()
DEC = """dec AS (SELECT *, sha256(shape || '|' || kind || '|' || place || '|' || with_system) AS stratum FROM (
  SELECT conv_id, turn, ordinal, decisions, with_system, length(text) AS chars, sha256(text) AS sha, CASE WHEN decisions > 1 THEN 'trajectory' ELSE 'simple' END AS shape, CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END AS kind, least(ordinal, 3) AS place, role
  FROM (SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS decisions, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS with_system FROM conversations)) WHERE role = 'assistant')"""
QUOTA = f"""{DEC}, qi AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY sha, conv_id, turn) AS i FROM dec),
quota AS (SELECT conv_id, turn, stratum, row_number() OVER (ORDER BY (i > 1)::INT, CASE WHEN i = 1 THEN n ELSE 0 END, CASE WHEN i = 1 THEN 0 ELSE (2 * i - 3) / (2 * (n - 1)) END, CASE WHEN i = 1 THEN stratum ELSE sha256(stratum || chr(31) || sha) END, conv_id, turn) AS pos FROM qi)"""


def _decisions(spark, sf_dir):
    return ordering.decisions(table(spark, sf_dir, "conversations"))


def _quota(spark, sf_dir):
    return ordering.quota_order(_decisions(spark, sf_dir).drop("text"), "stratum", "sha", ["conv_id", "turn"])


def _h(seed, col="doc_id"):
    return sampling.seeded(seed, F.col(col))


@query("""WITH h AS (SELECT conv_id, turn, role, length(text) AS target_chars, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal,
  string_agg(role || ':' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM conversations)
SELECT conv_id, turn, ordinal, sha256(coalesce(history, '')) AS history_sha, target_chars FROM h WHERE role = 'assistant'""")
def or_decisions(spark, sf_dir):
    """Assistant decisions with their ordinal, the rendered history before them, and the target."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    history = F.array_join(F.collect_list(F.concat("role", F.lit(":"), "text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), "\n")
    d = c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("target_chars"), F.count_if(F.col("role") == "assistant").over(w).alias("ordinal"), F.sha2(history, 256).alias("history_sha"))
    return d.filter("role = 'assistant'").drop("role")


@query(f"WITH {DEC} SELECT conv_id, turn, shape, kind, place, with_system, stratum FROM dec")
def or_stratum(spark, sf_dir):
    return _decisions(spark, sf_dir).select("conv_id", "turn", "shape", "kind", "place", "with_system", "stratum")


@query(f"WITH {QUOTA} SELECT conv_id, turn, pos FROM quota")
def or_quota(spark, sf_dir):
    return _quota(spark, sf_dir).select("conv_id", "turn", "pos")


@query(f"WITH {QUOTA} SELECT stratum, count(*) FILTER (WHERE pos <= 50) AS in_prefix, count(*) AS total FROM quota GROUP BY stratum")
def or_prefix_counts(spark, sf_dir):
    """Counts per stratum in the first 50 of the order; strata without any stay."""
    return _quota(spark, sf_dir).groupBy("stratum").agg(F.count_if(F.col("pos") <= 50).alias("in_prefix"), F.count("*").alias("total"))


@query(f"""WITH {QUOTA}, k AS (SELECT count(*) AS n, count(DISTINCT stratum) AS c FROM quota), cov AS (SELECT pos, ((2 * (pos - 1) + 1) * n) // (2 * c) AS place FROM quota, k WHERE pos <= c),
free AS (SELECT p AS place, row_number() OVER (ORDER BY p) AS j FROM (SELECT unnest(generate_series(0, n - 1)) AS p FROM k) WHERE p NOT IN (SELECT place FROM cov))
SELECT conv_id, turn, coalesce(cov.place, free.place) AS place FROM quota CROSS JOIN k LEFT JOIN cov USING (pos) LEFT JOIN free ON free.j = quota.pos - k.c""")
def or_spread(spark, sf_dir):
    q = staged(_quota(spark, sf_dir).select("conv_id", "turn", "stratum", "pos"), "quota")
    n, c = q.agg(F.count("*"), F.count_distinct("stratum")).first()
    return ordering.spread(q, c, n).select("conv_id", "turn", "place")


POOLS = f"""p AS (SELECT doc_id, lang, {SQUEEZED} AS t FROM documents WHERE lang IN ('en', 'fr')), a AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id), doc_id) - 1 AS i FROM p WHERE lang = 'en' AND t NOT IN (SELECT t FROM p WHERE lang = 'fr')),
b AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id), doc_id) - 1 AS i FROM p WHERE lang = 'fr'), k AS (SELECT least((SELECT count(*) FROM a) // 2, (SELECT count(*) FROM b)) AS c)"""


@query(f"""WITH {POOLS}, u AS (SELECT doc_id, CASE WHEN i < 2 * c THEN (i // 2) * 3 + i % 2 END AS slot, 0 AS pool, i FROM a, k UNION ALL SELECT doc_id, CASE WHEN i < c THEN i * 3 + 2 END, 1, i FROM b, k)
SELECT doc_id, row_number() OVER (ORDER BY (slot IS NULL)::INT, slot, pool, i) AS pos FROM u""")
def or_mix_cycle(spark, sf_dir):
    """Two pools interleaved by the cycle (first, first, second); overlapping rows of the first are left out, the tail completes."""
    p = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang", tx.digest(F.col("text")).alias("d"), _h(5).alias("h"))
    first = p.filter("lang = 'en'").join(p.filter("lang = 'fr'").select("d"), "d", "left_anti")
    a, b = (global_rank(x.select("doc_id", "h"), ["h", "doc_id"], "k").withColumn("i", F.col("k") - 1) for x in (first, p.filter("lang = 'fr'")))
    c = min(a.count() // 2, b.count())
    u = a.select("doc_id", F.when(F.col("i") < 2 * c, F.expr("(i div 2) * 3 + i % 2")).alias("slot"), F.lit(0).alias("pool"), "i").union(b.select("doc_id", F.when(F.col("i") < c, F.col("i") * 3 + 2).alias("slot"), F.lit(1).alias("pool"), "i"))
    return global_rank(u, [F.col("slot").isNull().cast("int"), "slot", "pool", "i"], "pos").select("doc_id", "pos")


@query("""WITH a AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS block, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE lang = 'en'), k AS (SELECT max(block) + 1 AS blocks, (SELECT count(*) FROM documents WHERE lang = 'es') AS c FROM a),
b AS (SELECT doc_id, ((2 * (row_number() OVER (ORDER BY doc_id) - 1) + 1) * blocks) // (2 * c) AS block, row_number() OVER (ORDER BY doc_id) AS i FROM documents, k WHERE lang = 'es'),
u AS (SELECT doc_id, block, 0 AS pulse, i FROM a UNION ALL SELECT doc_id, block, 1, i FROM b) SELECT doc_id, pulse, row_number() OVER (ORDER BY block, pulse, i) AS pos FROM u""")
def or_pulse(spark, sf_dir):
    """The parent order in whole blocks of ten, with format rows behind the blocks at centred quantiles."""
    d = table(spark, sf_dir, "documents")
    a = staged(global_rank(d.filter("lang = 'en'").select("doc_id"), ["doc_id"], "i").withColumn("block", F.expr("(i - 1) div 10")), "parent")
    b = staged(global_rank(d.filter("lang = 'es'").select("doc_id"), ["doc_id"], "i"), "pulse")
    blocks, c = (a.agg(F.max("block")).first()[0] or 0) + 1, max(b.count(), 1)
    u = a.select("doc_id", "block", F.lit(0).alias("pulse"), "i").union(b.select("doc_id", F.expr(f"((2 * (i - 1) + 1) * {blocks}) div {2 * c}").alias("block"), F.lit(1).alias("pulse"), "i"))
    return global_rank(u, ["block", "pulse", "i"], "pos").select("doc_id", "pulse", "pos")


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS a, count(*) FILTER (WHERE role = 'user') AS u, sum(length(text)) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, 3.0 * (greatest(a, 1) - 1) + 1.5 * greatest(0, u - 1) + 0.6 * (u > 0)::INT + 1.0 * (a = 0)::INT + 0.25 * (n / 40) AS score FROM c)
SELECT conv_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6), sha1(conv_id::VARCHAR)) AS pos FROM s""")
def or_curriculum(spark, sf_dir):
    """Easy to hard: weights 3, 1.5, 0.6, 1 and 0.25 on extra calls, extra arguments, any argument, abstention and length / 40."""
    r = F.col("role")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(r == "assistant").alias("a"), F.count_if(r == "user").alias("u"), F.sum(F.length("text")).alias("n"))
    score = 3.0 * (F.greatest("a", F.lit(1)) - 1) + 1.5 * F.greatest(F.lit(0), F.col("u") - 1) + 0.6 * (F.col("u") > 0).cast("int") + 1.0 * (F.col("a") == 0).cast("int") + 0.25 * (F.col("n") / 40)
    s = c.select("conv_id", F.round(score, 6).alias("score"), F.sha1(F.col("conv_id").cast("string").cast("binary")).alias("h"))
    return global_rank(s, ["score", "h"], "pos").drop("h")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS round FROM documents) SELECT doc_id, row_number() OVER (ORDER BY round, sha256(lang), doc_id) AS pos FROM r ORDER BY pos LIMIT 40""")
def or_balanced_shortest(spark, sf_dir):
    """Round-robin over buckets, shortest first in each, the first 40."""
    d = sampling.top_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang"], ["n_chars", "doc_id"], 40)
    r = d.withColumn("round", F.row_number().over(Window.partitionBy("lang").orderBy("n_chars", "doc_id"))).orderBy("round", F.sha2("lang", 256), "doc_id").limit(40)
    return r.select("doc_id", F.row_number().over(Window.orderBy("round", F.sha2("lang", 256), "doc_id")).cast("long").alias("pos"))  # 40 rows


@query("""WITH h AS (SELECT doc_id, sha256('4:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('4:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id FROM h ORDER BY (k > 1)::INT, h, doc_id LIMIT 50""")
def or_top_per_group(spark, sf_dir):
    """The first by hash of every source, filled up by hash to 50."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", _h(4).alias("h"))
    first = d.groupBy("source").agg(F.min(F.struct("h", "doc_id")).alias("w")).select("w.doc_id").withColumn("lead", F.lit(0))
    return d.join(first, "doc_id", "left").orderBy(F.coalesce("lead", F.lit(1)), "h", "doc_id").limit(50).select("doc_id")


@query("""WITH RECURSIVE r AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY sha256('6:' || doc_id), doc_id) AS i FROM documents),
walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS cl, []::VARCHAR[] AS tl, NULL::BIGINT AS doc_id, NULL::VARCHAR AS source, NULL::VARCHAR AS lang, NULL::VARCHAR AS state
UNION ALL SELECT i, CASE WHEN state = 'taken' THEN list_append(cl, source) ELSE cl END, CASE WHEN state = 'taken' THEN list_append(tl, lang) ELSE tl END, doc_id, source, lang, state FROM
  (SELECT r.*, walk.cl, walk.tl, CASE WHEN len(cl) = 30 THEN 'cut' WHEN len([x for x in cl if x = r.source]) >= 3 THEN 'cluster_full' WHEN len([x for x in tl if x = r.lang]) >= 10 THEN 'template_full' ELSE 'taken' END AS state FROM walk JOIN r ON r.i = walk.i + 1))
SELECT doc_id, source, lang, state FROM walk WHERE i > 0""")
def sm_capped_select(spark, sf_dir):
    """Seeded walk under two caps, three a source and ten a language, up to 30 rows; at least 20 of five sources, or it fails. Why the others were skipped is told."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", _h(6).alias("h"))
    return ordering.capped_select(d, ["h", "doc_id"], "source", "lang", 3, 10, 30, 20, 5).select("doc_id", "source", "lang", "state")


STRATA = "SELECT doc_id, unnest(['lang:' || lang, 'source:' || source, 'size:' || floor(ln(n_chars + 1))::INT]) AS stratum FROM documents"


def _strata(spark, sf_dir):
    s = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("size:"), F.floor(F.log(F.col("n_chars") + 1.0)).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", _h(8).alias("h"), F.explode(s).alias("stratum"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, sha256('8:' || doc_id) AS h, list(stratum) AS st FROM ({STRATA}) GROUP BY doc_id),
walk AS (SELECT 0::BIGINT AS round, []::VARCHAR[] AS got, NULL::BIGINT AS doc_id UNION ALL
  (SELECT walk.round + 1, list_concat(walk.got, d.st), d.doc_id FROM walk, d WHERE len([x for x in d.st if NOT list_contains(walk.got, x)]) > 0 ORDER BY len([x for x in d.st if NOT list_contains(walk.got, x)]) DESC, d.h, d.doc_id LIMIT 1)),
c AS (SELECT doc_id, 'cover' AS kind FROM walk WHERE round > 0), o AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS k FROM d WHERE doc_id NOT IN (SELECT doc_id FROM c)),
u AS (SELECT * FROM c UNION ALL SELECT doc_id, 'fill' FROM o WHERE k <= 100 - (SELECT count(*) FROM c)) SELECT doc_id, kind, row_number() OVER (ORDER BY doc_id) AS pos FROM u""")
def sm_cover(spark, sf_dir):
    """Greedy cover of all strata, ties by hash, filled up by hash to 100 rows, in source order."""
    return ordering.greedy_cover(_strata(spark, sf_dir).withColumnRenamed("doc_id", "row_id"), 100).select(F.col("row_id").alias("doc_id"), "kind", "pos")


@query(f"SELECT stratum, count(*) AS documents FROM ({STRATA}) GROUP BY stratum")
def sm_strata(spark, sf_dir):
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("documents"))


@query(f"""WITH d AS (SELECT doc_id, {SQUEEZED} AS t, ('0x' || substr(sha256('9:' || doc_id), 1, 15))::BIGINT % 100 AS b FROM documents) SELECT doc_id FROM d WHERE b BETWEEN 10 AND 19 AND t NOT IN (SELECT t FROM d WHERE b < 10)""")
def sm_confirmatory(spark, sf_dir):
    """A second subset that shares neither identity nor text with the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.digest(F.col("text")).alias("t"), sampling.bucket(F.col("doc_id"), 100, 9).alias("b"))
    first = d.filter("b < 10")
    return d.filter("b BETWEEN 10 AND 19").join(first.select("t"), "t", "left_anti").join(first.select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos <= least(greatest(round_even(n * 0.01, 0), 1), n - 1) THEN 'validation' ELSE 'train' END AS split FROM r""")
def sm_split_exact(spark, sf_dir):
    return sampling.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.01, 7)


@query("SELECT conv_id, turn, CASE WHEN ('0x' || substr(sha256('0:' || conv_id), 1, 15))::BIGINT % 100 < 10 THEN 'eval' ELSE 'train' END AS side FROM conversations")
def sm_split_bucket(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(sampling.bucket(F.col("conv_id")) < 10, "eval").otherwise("train").alias("side"))


@query("WITH p AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, ('0x' || substr(sha256(lower(prompt)), 1, 2))::INT % 10 = 0 AS held_out FROM p")
def sm_split_prompt_byte(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("p"))
    return p.select("conv_id", (F.conv(F.substring(F.sha2(F.lower("p"), 256), 1, 2), 16, 10).cast("int") % 10 == 0).alias("held_out"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT doc_id, x AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(x) > 40),
m AS (SELECT line, min(doc_id) AS a FROM l GROUP BY line), e AS (SELECT DISTINCT a, doc_id AS b FROM l JOIN m USING (line) WHERE a <> doc_id), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, label) USING KEY (node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.node, min(v.label) FROM recurring.cc u JOIN both_ways w ON w.a = u.node JOIN cc v ON v.node = w.b WHERE v.label < u.label GROUP BY u.node)
SELECT node AS doc_id, label, CASE WHEN ('0x' || substr(sha256(label::VARCHAR), 1, 8))::BIGINT % 100 < 10 THEN 'eval' ELSE 'train' END AS side FROM cc""")
def sm_split_components(spark, sf_dir):
    """Documents that share a line of over 40 characters move together."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.length("l") > 40).select("doc_id", F.sha2("l", 256).alias("key")).distinct()
    every = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("own:"), "doc_id").alias("key"))
    return ordering.component_sides(d.union(every), "doc_id", "key", 10)


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('12:' || sha256(text)), 1, 15))::BIGINT < 0.1 * 1152921504606846976")
def sm_fraction(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(tx.hash60(F.lit(12), F.sha2("text", 256)) < 0.1 * (1 << 60)).select("doc_id")


@query("WITH k AS (SELECT doc_id, sha256('13:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('13:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS pos FROM k WHERE k <= 20")
def sm_cap_per_source(spark, sf_dir):
    d = sampling.top_per_group(table(spark, sf_dir, "documents").select("doc_id", "source", _h(13).alias("h")), ["source"], ["h", "doc_id"], 20)
    return global_rank(d, ["h", "doc_id"], "pos").select("doc_id", "pos")


@query("""WITH w AS (SELECT lang AS name, count(*) AS weight FROM documents GROUP BY lang), q AS (SELECT name, weight, 1000003 * weight // sum(weight) OVER () AS f, 1000003 * weight - (1000003 * weight // sum(weight) OVER ()) * sum(weight) OVER () AS rest FROM w)
SELECT name, weight, (f + (row_number() OVER (ORDER BY rest DESC, name) <= 1000003 - sum(f) OVER ())::INT)::BIGINT AS budget FROM q""")
def sm_budget_alloc(spark, sf_dir):
    """A total of 1,000,003 characters over languages, by largest remainder."""
    return sampling.apportion(table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("weight")), 1_000_003)


@query("""WITH o AS (SELECT doc_id, lang, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY sha256('14:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT doc_id, lang, n_chars FROM o WHERE before < 50000""")
def sm_budget_take(spark, sf_dir):
    """Per language, rows in seeded order until the characters first reach 50,000."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", _h(14).alias("h"))
    return rank_within(d, "lang", ["h", "doc_id"], "before", "all_chars", F.col("n_chars")).filter("before < 50000").select("doc_id", "lang", "n_chars")


@query("""WITH o AS (SELECT n_chars, coalesce(sum(n_chars) OVER (ORDER BY sha256('15:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM o WHERE before < 500000""")
def sm_min_prefix(spark, sf_dir):
    """The smallest prefix of the seeded order with at least 500,000 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", _h(15).alias("h"))
    return global_rank(d, ["h", "doc_id"], "before", F.col("n_chars")).filter("before < 500000").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('16:' || doc_id), doc_id) AS pos FROM documents")
def sm_shuffle(spark, sf_dir):
    return global_rank(table(spark, sf_dir, "documents").select("doc_id", _h(16).alias("h")), ["h", "doc_id"], "pos").select("doc_id", "pos")


#: Draws that the schedule serves.
DRAWS = 400


@query(f"""WITH RECURSIVE s AS (SELECT source, count(*) / (SELECT count(*) FROM documents) AS a, sum(n_chars) / (SELECT sum(n_chars) FROM documents) AS b FROM documents WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT list(source ORDER BY source) AS names, list(a ORDER BY source) AS a, list(b ORDER BY source) AS b FROM s),
r AS (SELECT 0 AS step, list_transform(a, lambda x: 0.0::DOUBLE) AS target, list_transform(a, lambda x: 0::BIGINT) AS served FROM l
  UNION ALL SELECT step + 1, target, list_transform(served, lambda x, i: x + (i = pick)::INT) FROM (SELECT step, target, served, list_position(list_transform(target, lambda x, i: x - served[i] >= list_max(list_transform(target, lambda y, j: y - served[j])) - 1e-9), true) AS pick
    FROM (SELECT step, served, list_transform(target, lambda x, i: x + a[i] + (b[i] - a[i]) * step / {DRAWS - 1}) AS target FROM r, l WHERE step < {DRAWS}))),
z AS (SELECT unnest(names) AS source, unnest(target) AS target, unnest(served) AS served FROM r, l WHERE step = {DRAWS})
SELECT source, round(target, 6) AS target, served, round(served / {DRAWS}, 6) AS share, round(target - served, 6) AS deficit FROM z""")
def sm_mixture_schedule(spark, sf_dir):
    """Draws served one by one to the source that is owed most, while weights move from documents' to characters' shares; ties go to the first by name."""
    s = table(spark, sf_dir, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    w = Window.partitionBy()  # one row a source
    s = s.select("source", (F.col("n") / F.sum("n").over(w)).alias("a"), (F.col("c") / F.sum("c").over(w)).alias("b"))
    one = s.agg(F.array_sort(F.collect_list(F.struct("source", "a", "b"))).alias("s"))
    return one.select(F.inline(ordering.serve(F.col("s"), DRAWS))).select("source", F.round("target", 6).alias("target"), "served", F.round(F.col("served") / DRAWS, 6).alias("share"), F.round(F.col("target") - F.col("served"), 6).alias("deficit"))


@query("""WITH e AS (SELECT event_id, event_type, ('0x' || substr(sha256('17:' || event_id), 1, 15))::BIGINT AS h, CASE event_type WHEN 'purchase' THEN 0.5 WHEN 'error' THEN 0.0 ELSE 0.1 END AS w FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS k FROM e WHERE h < w * 1152921504606846976) SELECT event_id, event_type FROM k WHERE k <= 300""")
def sm_weighted_categories(spark, sf_dir):
    """Samples by category weight, at most 300 a category."""
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", tx.hash60(F.lit(17), F.col("event_id")).alias("h"))
    e = e.filter(F.col("h") < F.when(t == "purchase", 0.5).when(t == "error", 0.0).otherwise(0.1) * (1 << 60))
    return sampling.top_per_group(e, ["event_type"], ["h", "event_id"], 300).select("event_id", "event_type")


#: crc32 in SQL, from its table, for each distinct n-gram; then sparse vectors by dimension.
NGRAMS = """WITH tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
x AS (SELECT 'd' AS side, doc_id AS id, ' ' || lower(text) || ' ' AS t FROM documents UNION ALL SELECT 'q', item_id, ' ' || lower(text) || ' ' FROM benchmark WHERE item_id % 20 = 0),
g AS (SELECT side, id, g, count(*) AS c FROM (SELECT side, id, unnest([substr(t, i, n) for i in generate_series(1, length(t) - n + 1)]) AS g FROM x, (VALUES (3), (4), (5)) v(n) WHERE length(t) >= n) GROUP BY ALL),
h AS (SELECT g, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(hex(encode(g)), 2 * k - 1, 2))::BIGINT for k in generate_series(1, octet_length(encode(g)))]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 8192 AS dim FROM (SELECT DISTINCT g FROM g), tab),
v AS (SELECT side, id, dim, sum(c)::DOUBLE AS c FROM g JOIN h USING (g) GROUP BY side, id, dim), n AS (SELECT side, id, sqrt(sum(c * c)) AS norm FROM v GROUP BY side, id),
s AS (SELECT q.id AS query_id, d.id AS item_id, sum(q.c * d.c) AS dot FROM v q JOIN v d USING (dim) WHERE q.side = 'q' AND d.side = 'd' GROUP BY q.id, d.id)
SELECT query_id, item_id, round(dot / (a.norm * b.norm), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / (a.norm * b.norm), 6) DESC, item_id) AS rank FROM s JOIN n a ON a.side = 'q' AND a.id = query_id JOIN n b ON b.side = 'd' AND b.id = item_id QUALIFY rank <= 5"""


@query(NGRAMS)
def or_topk_ngram(spark, sf_dir):
    """The five documents nearest to every twentieth benchmark item by hashed character n-grams."""
    q = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return ngram_topk(q, spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")), 5)
