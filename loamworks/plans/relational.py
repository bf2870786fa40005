"""Joins and aggregations over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ranks import global_rank
from ..operators import sampling
from ..operators.retrieval import cosine_topk
from ..operators.scoring import oracle_candidates
from ..registry import Register
from ..sources.stages import table
from .corpus import SQUEEZED, TOKENS
from .standins import CALLS, SCORED, calls, scored

QUERIES = query = Register()
D = f"d AS (SELECT doc_id, source, lang, n_chars, sha256({SQUEEZED}) AS digest, sha256(text) AS sha FROM documents)"
#: A frozen assignment made from the documents: some are missing from it, and some have changed since.
FROZEN = "z AS (SELECT doc_id AS identity, CASE WHEN doc_id % 97 = 0 THEN sha256('old') ELSE sha END AS frozen_sha, CASE WHEN ('0x' || substr(sha256('3:' || doc_id), 1, 15))::BIGINT % 100 < 5 THEN 'validation' ELSE 'train' END AS split FROM d WHERE doc_id % 50 <> 0)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", tx.digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("sha"))


def _frozen(d):
    sha = F.when(F.col("doc_id") % 97 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("sha"))
    split = F.when(sampling.bucket(F.col("doc_id"), 100, 3) < 5, "validation").otherwise("train")
    return d.filter("doc_id % 50 <> 0").select(F.col("doc_id").alias("identity"), sha.alias("frozen_sha"), split.alias("split"))


@query(f"WITH {D}, p AS (SELECT digest, source, count(*) AS occurrences FROM d GROUP BY ALL) SELECT d.doc_id, p.source, p.occurrences FROM p JOIN d USING (digest)")
def jn_inner_using(spark, sf_dir):
    d = _docs(spark, sf_dir)
    p = d.groupBy("digest", "source").agg(F.count("*").alias("occurrences"))
    return p.join(d.select("digest", "doc_id"), "digest").select("doc_id", "source", "occurrences")


@query(f"WITH {D}, w AS (SELECT digest, arg_min(source, doc_id) AS kept FROM d GROUP BY digest) SELECT d.doc_id, d.source IS NOT DISTINCT FROM w.kept AS same_source FROM d JOIN w USING (digest)")
def jn_alias_flag(spark, sf_dir):
    d = _docs(spark, sf_dir)
    w = d.groupBy("digest").agg(F.min_by("source", "doc_id").alias("kept"))
    return d.join(w, "digest").select("doc_id", F.col("source").eqNullSafe(F.col("kept")).alias("same_source"))


@query(f"WITH {D}, w AS (SELECT digest, min(doc_id) AS doc_id, max(n_chars) AS n FROM d GROUP BY digest), r AS (SELECT digest, row_number() OVER (ORDER BY n DESC, digest) AS pos FROM w) SELECT d.doc_id, r.pos FROM r JOIN d USING (digest)")
def jn_queue_fetch(spark, sf_dir):
    """A rank queue of digests joined to the documents."""
    d = _docs(spark, sf_dir)
    queue = global_rank(d.groupBy("digest").agg(F.max("n_chars").alias("n")), [F.desc("n"), "digest"], "pos")
    return queue.select("digest", "pos").join(d.select("digest", "doc_id"), "digest").select("doc_id", "pos")


@query(f"WITH {D}, {FROZEN} SELECT doc_id, (SELECT split FROM z WHERE identity = doc_id) AS split FROM d")
def jn_split_lookup(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.join(_frozen(d), d["doc_id"] == F.col("identity"), "left").select("doc_id", "split")


@query(f"WITH {D}, r AS (SELECT digest, row_number() OVER (ORDER BY digest) AS pos FROM (SELECT DISTINCT digest FROM d)) SELECT doc_id, (SELECT pos FROM r WHERE r.digest = d.digest) AS pos FROM d")
def jn_rank_lookup(spark, sf_dir):
    d = _docs(spark, sf_dir)
    r = global_rank(d.select("digest").distinct(), ["digest"], "pos")
    return d.join(r, "digest", "left").select("doc_id", "pos")


@query(f"""WITH {D}, {FROZEN} SELECT coalesce(CASE WHEN z.identity IS NULL THEN 'missing' WHEN d.sha <> z.frozen_sha THEN 'changed' END, 'bound') AS state, coalesce(split, 'none') AS split, count(*) AS documents
FROM d LEFT JOIN z ON d.doc_id = z.identity GROUP BY 1, 2""")
def jn_frozen_split(spark, sf_dir):
    """Documents against a frozen assignment: bound, changed or missing, as an audit."""
    d = _docs(spark, sf_dir)
    state = F.when(F.col("identity").isNull(), "missing").when(F.col("sha") != F.col("frozen_sha"), "changed").otherwise("bound")
    j = d.join(_frozen(d), d["doc_id"] == F.col("identity"), "left").select(state.alias("state"), F.coalesce("split", F.lit("none")).alias("split"))
    return j.groupBy("state", "split").agg(F.count("*").alias("documents"))


@query(f"""WITH {D}, {FROZEN}, b AS (SELECT z.identity, count(*) AS n FROM z JOIN d ON d.doc_id = z.identity AND d.sha = z.frozen_sha GROUP BY z.identity)
SELECT (SELECT count(*) FROM b WHERE n = 1) AS bound_once, (SELECT count(*) FROM z WHERE identity NOT IN (SELECT identity FROM b)) AS unseen, (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT identity FROM b)) AS unbound""")
def jn_parent_seen(spark, sf_dir):
    d = _docs(spark, sf_dir)
    z = _frozen(d)
    b = d.join(z, (d["doc_id"] == z["identity"]) & (d["sha"] == z["frozen_sha"])).groupBy("identity").agg(F.count("*").alias("n"))
    once = b.agg(F.count_if(F.col("n") == 1).alias("bound_once"))
    unseen = z.join(b, "identity", "left_anti").agg(F.count("*").alias("unseen"))
    unbound = d.join(b, d["doc_id"] == b["identity"], "left_anti").agg(F.count("*").alias("unbound"))
    return once.crossJoin(F.broadcast(unseen)).crossJoin(F.broadcast(unbound))


@query(f"WITH {SCORED} SELECT doc_id, a.grp, round(a.nll - b.nll, 4) AS delta, a.tokens FROM scored a JOIN scored b USING (doc_id) WHERE a.arm = 'a' AND b.arm = 'b'")
def jn_paired_arms(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = s.groupBy("doc_id", "grp", "tokens").agg(F.sum(F.when(F.col("arm") == "a", F.col("nll"))).alias("x"), F.sum(F.when(F.col("arm") == "b", F.col("nll"))).alias("y"), F.count("*").alias("n"))
    # Keys must match exactly: a document without either arm is an error.
    return p.select("doc_id", "grp", F.when(F.assert_true(F.col("n") == 2, "unpaired document").isNull(), F.round(F.col("x") - F.col("y"), 4)).alias("delta"), "tokens")


@query(f"WITH {CALLS}, t AS (SELECT case_id, coalesce(list(DISTINCT name) FILTER (WHERE side = 'gold'), []) AS g, coalesce(list(DISTINCT name) FILTER (WHERE side = 'pred'), []) AS p FROM calls GROUP BY 1) SELECT case_id, array_to_string(list_sort([x for x in g if NOT list_contains(p, x)]), ',') AS missing, len([x for x in g if NOT list_contains(p, x)]) = 0 AS complete FROM t")
def jn_oracle_candidates(spark, sf_dir):
    """Gold names against each task's candidate names: the names that the candidates lack. A task on one side only fails the query."""
    c = calls(spark, sf_dir)
    gold = c.filter("side = 'gold'").groupBy("case_id").agg(F.collect_set("name").alias("g"))
    found = c.filter("side = 'pred'").groupBy("case_id").agg(F.collect_set("name").alias("p"))
    # A task without predictions has candidates all the same: none.
    candidates = gold.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("p", F.array().cast("array<string>")).alias("p"))
    return oracle_candidates(gold, candidates, "case_id")


SEEN = "t AS (SELECT doc_id, lang, source, right(text, 400) AS tail FROM documents), tr AS (SELECT * FROM t WHERE doc_id % 5 <> 0)"


@query(f"WITH {SEEN} SELECT doc_id, EXISTS (SELECT 1 FROM tr WHERE tr.tail = t.tail AND tr.lang = t.lang AND tr.source = t.source) AS same_arguments FROM t WHERE doc_id % 5 = 0 AND EXISTS (SELECT 1 FROM tr WHERE tr.tail = t.tail AND tr.lang = t.lang)")
def jn_semi_seen(spark, sf_dir):
    """Held-out rows whose last 400 characters (observation) and lang (tool) occur in training rows; the second pass asks for the same source (arguments) too."""
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.right("text", F.lit(400)), 256).alias("tail"))
    train = t.filter("doc_id % 5 <> 0").select("tail", "lang", "source").distinct()
    seen = t.filter("doc_id % 5 = 0").join(train.select("tail", "lang").distinct(), ["tail", "lang"], "left_semi")
    same = train.withColumn("hit", F.lit(True))
    return seen.join(same, ["tail", "lang", "source"], "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("same_arguments"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem t WHERE l_orderkey % 10 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey % 10 <> 0 AND x.l_partkey = t.l_partkey AND x.l_suppkey = t.l_suppkey AND x.l_returnflag = t.l_returnflag)")
def jn_anti_clean(spark, sf_dir):
    """Evaluation rows of which the (observation, tool, arguments) key never occurs in training rows."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return l.filter("l_orderkey % 10 = 0").join(l.filter("l_orderkey % 10 <> 0"), ["l_partkey", "l_suppkey", "l_returnflag"], "left_anti").select("l_orderkey", "l_linenumber")


@query("""WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum([x::DOUBLE * x for x in embedding])) AS norm FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum([q.embedding[i]::DOUBLE * c.embedding[i] for i in generate_series(1, len(q.embedding))]) / (q.norm * c.norm), 6) AS score FROM n q, n c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def jn_topk_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cosine_topk(e.filter("vec_id % 20 = 0"), e, 5).select("query_id", "vec_id", "score", "rank")


@query("WITH g AS (SELECT source, dense_rank() OVER (ORDER BY source) AS k FROM documents) SELECT CASE WHEN k <= 8 THEN source ELSE '__other__' END AS grp, count(*) AS documents FROM g GROUP BY 1")
def agg_bounded_groups(spark, sf_dir):
    """Counts of the first eight groups by name; the rest folded into one."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    first = F.broadcast(g.select(F.col("source").alias("grp")).orderBy("grp").limit(8))
    return g.join(first, F.col("source").eqNullSafe(F.col("grp")), "left").groupBy(F.coalesce("grp", F.lit("__other__")).alias("grp")).agg(F.sum("n").alias("documents"))


CHUNKS = ", ".join(f"(sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT AS sum{i}, bit_xor(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT) AS xor{i}" for i in range(4))


@query(f"SELECT source, count(*) AS n, {CHUNKS} FROM (SELECT source, sha256(doc_id || ':' || sha256(text)) AS h FROM documents) GROUP BY source")
def agg_multiset_fp(spark, sf_dir):
    """Order-free fingerprint of a bag: count, and sums mod 2**60 and xors of four 60-bit chunks of each member's sha256."""
    h = table(spark, sf_dir, "documents").select("source", F.sha2(F.concat_ws(":", "doc_id", F.sha2("text", 256)), 256).alias("h"))
    aggs = []
    for i in range(4):
        c = F.conv(F.substring("h", 15 * i + 1, 15), 16, 10)
        aggs += [(F.sum(c.cast("decimal(20,0)")) % F.lit(1 << 60).cast("decimal(20,0)")).cast("long").alias(f"sum{i}"), F.bit_xor(c.cast("long")).alias(f"xor{i}")]
    return h.groupBy("source").agg(F.count("*").alias("n"), *aggs)


@query("SELECT lang, count(DISTINCT source) AS members, sha256(string_agg(DISTINCT source, chr(10) ORDER BY source)) AS fingerprint FROM documents GROUP BY lang")
def agg_set_fp(spark, sf_dir):
    """sha256 of the sorted members, for sets of bounded size (sources); bags of documents take agg_multiset_fp."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("m")).select("lang", F.size("m").cast("long").alias("members"), F.sha2(F.array_join("m", "\n"), 256).alias("fingerprint"))


@query(f"WITH {D}, {FROZEN} SELECT split, count(*) AS documents, count(DISTINCT identity) AS identities, count(DISTINCT frozen_sha) AS contents, bit_xor(('0x' || substr(sha256(identity::VARCHAR), 1, 15))::BIGINT) AS id_fingerprint, bit_xor(('0x' || substr(sha256(identity || ':' || frozen_sha), 1, 15))::BIGINT) AS content_fingerprint FROM z GROUP BY split")
def agg_split_counts(spark, sf_dir):
    """Documents of each split, distinct identities and contents, and fingerprints of both that no order changes."""
    i, c = F.col("identity"), F.col("frozen_sha")
    return _frozen(_docs(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("documents"), F.count_distinct(i).alias("identities"), F.count_distinct(c).alias("contents"), F.bit_xor(tx.hash60(i)).alias("id_fingerprint"), F.bit_xor(tx.hash60(i, c)).alias("content_fingerprint"))


@query("SELECT source, sum(octet_length(encode(text)) + ceil(octet_length(encode(text)) / 2048.0)::BIGINT)::BIGINT AS tokens FROM documents GROUP BY source")
def agg_token_account(spark, sf_dir):
    """Byte tokens per source, with one end mark for each packed piece of up to 2,048."""
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n + F.ceil(n / 2048)).cast("long").alias("tokens"))


@query("SELECT lang, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high, sum(n_chars)::BIGINT AS total, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY lang")
def agg_length_dist(spark, sf_dir):
    """Nearest-rank percentiles from counts per length: the counts are partial aggregates, and a length is one row."""
    c = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("n_chars")
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("lang")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(p)), F.col("n_chars")))
    return c.groupBy("lang").agg(F.max("n").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.sum(F.col("n_chars") * F.col("c")).alias("total"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"))


@query(f"""WITH r AS (SELECT conv_id, turn, role, sum(len({TOKENS}) + 3) OVER (PARTITION BY conv_id ORDER BY turn) AS running, len({TOKENS}) AS own FROM conversations)
SELECT max(running - own)::BIGINT AS longest_prompt, max(running - own)::BIGINT + 256 AS required_context, count(*) FILTER (WHERE running - own + 256 > 512) AS over_budget, count(*) AS decisions FROM r WHERE role = 'assistant'""")
def agg_prompt_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(tx.tokens(F.col("text"))).alias("own"))
    r = c.withColumn("prompt", F.sum(F.col("own") + 3).over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("own")).filter("role = 'assistant'")
    return r.agg(F.max("prompt").alias("longest_prompt"), (F.max("prompt") + 256).alias("required_context"), F.count_if(F.col("prompt") + 256 > 512).alias("over_budget"), F.count("*").alias("decisions"))


@query("""WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS decisions, bool_or(role = 'system') AS sys FROM conversations GROUP BY conv_id)
SELECT CASE WHEN conv_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split, count(*) AS rows, sum(decisions)::BIGINT AS decisions, count(*) FILTER (WHERE decisions > 1) AS multi_step, count(*) FILTER (WHERE sys) AS with_system FROM c GROUP BY 1""")
def agg_conv_profile(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("d"), F.bool_or(F.col("role") == "system").alias("sys"))
    return c.groupBy(F.when(F.col("conv_id") % 10 == 0, "eval").otherwise("train").alias("split")).agg(F.count("*").alias("rows"), F.sum("d").alias("decisions"), F.count_if(F.col("d") > 1).alias("multi_step"), F.count_if("sys").alias("with_system"))


@query("""SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY tag""")
def agg_metadata_profile(spark, sf_dir):
    """Counts by facet, multi-valued tags among them, in one pass."""
    facets = F.array_union(F.array(F.struct(F.lit("brand").alias("facet"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("p_type").alias("value"))), F.transform(F.split("p_type", " "), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))
    return table(spark, sf_dir, "part").select(F.explode(facets).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


@query("SELECT user_id % 7 AS model, CASE WHEN event_type IN ('click', 'view') THEN 'look' WHEN event_type = 'purchase' THEN 'commit' ELSE 'other' END AS family, count(*) AS steps, count(*) FILTER (WHERE json_valid(props)) AS parseable FROM events GROUP BY 1, 2")
def agg_trajectory_profile(spark, sf_dir):
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("model"), F.when(t.isin("click", "view"), "look").when(t == "purchase", "commit").otherwise("other").alias("family"), F.try_parse_json("props").isNotNull().alias("ok"))
    return e.groupBy("model", "family").agg(F.count("*").alias("steps"), F.count_if("ok").alias("parseable"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, round(n / (SELECT count(*) FROM embeddings), 6) AS rate FROM c ORDER BY n DESC, label LIMIT 1")
def agg_majority(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.orderBy(F.desc("n"), "label").limit(1).crossJoin(F.broadcast(total)).select("label", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT round(avg(1.0 / n), 6) AS chance, min(n) AS low, round(avg(n), 6) AS mean, max(n) AS high FROM c")
def agg_chance(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.agg(F.round(F.avg(1 / F.col("n")), 6).alias("chance"), F.min("n").alias("low"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("high"))


@query(f"""WITH {CALLS}, g AS (SELECT case_id, any_value(name) FILTER (WHERE pos = 1) AS gold, list(DISTINCT name) AS catalog FROM calls WHERE side = 'gold' GROUP BY 1), p AS (SELECT case_id, name FROM calls WHERE side = 'pred' AND pos = 1),
b AS (SELECT CASE WHEN p.name IS NULL THEN 'parse_fail' WHEN p.name = g.gold THEN 'correct_name' WHEN list_contains(g.catalog, p.name) THEN 'wrong_in_catalog' ELSE 'out_of_catalog' END AS bucket FROM g LEFT JOIN p USING (case_id))
SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY bucket""")
def agg_error_mechanism(spark, sf_dir):
    c = calls(spark, sf_dir)
    gold, first = F.col("side") == "gold", F.col("pos") == 1
    b = c.groupBy("case_id").agg(F.max(F.when(gold & first, F.col("name"))).alias("g"), F.max(F.when(~gold & first, F.col("name"))).alias("p"), F.collect_set(F.when(gold, F.col("name"))).alias("cat"))
    bucket = F.when(F.col("p").isNull(), "parse_fail").when(F.col("p") == F.col("g"), "correct_name").when(F.array_contains("cat", F.col("p")), "wrong_in_catalog").otherwise("out_of_catalog")
    n = b.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT source, round(avg(quality), 6) AS accuracy, round(1.0 * (1 + 2.0 * (1 - avg(quality))), 2) AS weight FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY accuracy, source LIMIT 5")
def agg_reweight(spark, sf_dir):
    """The five weakest categories and their weights for the next round."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    g = j.groupBy("source").agg(F.avg("quality").alias("a"))
    return g.select("source", F.round("a", 6).alias("accuracy"), F.round(1.0 * (1 + 2.0 * (1 - F.col("a"))), 2).alias("weight")).orderBy("accuracy", "source").limit(5)


@query("WITH e AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 10 = 0), t AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 10 <> 0) SELECT count(*) AS labels, count(*) FILTER (WHERE p_type IN (SELECT p_type FROM t)) AS known, round(count(*) FILTER (WHERE p_type IN (SELECT p_type FROM t)) / count(*), 6) AS share FROM e")
def agg_toolbox_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.bool_or(F.col("p_partkey") % 10 == 0).alias("e"), F.bool_or(F.col("p_partkey") % 10 != 0).alias("t")).filter("e")
    return p.agg(F.count("*").alias("labels"), F.count_if("t").alias("known"), F.round(F.count_if("t") / F.count("*"), 6).alias("share"))


@query("SELECT user_id AS run_id, event_type AS key, arg_max(value, event_id) AS latest, count(*) AS points FROM events GROUP BY 1, 2")
def agg_metric_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("latest"), F.count("*").alias("points"))


@query("SELECT event_type AS kind, (max(struct_pack(ts := ts, id := event_id))).id AS artifact FROM events GROUP BY 1")
def agg_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("artifact"))


@query(f"""WITH {D}, t AS (SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT digest) AS kept FROM d), r AS (SELECT sum(c - 1)::BIGINT AS removed FROM (SELECT count(*) AS c FROM d GROUP BY digest))
SELECT 'kept + removed = input' AS rule, n AS expected, kept + removed AS observed, n = kept + removed AS ok FROM t, r UNION ALL SELECT 'characters by source = characters', chars, (SELECT sum(c)::BIGINT FROM (SELECT sum(n_chars) AS c FROM d GROUP BY source)), true FROM t""")
def agg_accounting_identities(spark, sf_dir):
    d = _docs(spark, sf_dir)
    t = d.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    k = d.groupBy("digest").agg(F.count("*").alias("c")).agg(F.count("*").alias("kept"), F.sum(F.col("c") - 1).alias("removed"))
    s = d.groupBy("source").agg(F.sum("n_chars").alias("c")).agg(F.sum("c").alias("by_source"))
    one = t.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(s))
    kr = F.col("kept") + F.col("removed")
    rules = F.array(F.struct(F.lit("kept + removed = input").alias("rule"), F.col("n").alias("expected"), kr.alias("observed"), (F.col("n") == kr).alias("ok")), F.struct(F.lit("characters by source = characters").alias("rule"), F.col("chars").alias("expected"), F.col("by_source").alias("observed"), (F.col("chars") == F.col("by_source")).alias("ok")))
    return one.select(F.explode(rules).alias("x")).select("x.*")


