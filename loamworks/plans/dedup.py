"""Deduplication and contamination over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ranks import global_rank
from ..operators import contamination, dedup, filters
from ..registry import Register
from ..sources.pools import Winners
from ..sources.stages import release, spread, staged, table
from ..streaming import jobs
from .corpus import CODE, SQUEEZED, TOKENS

QUERIES = query = Register()
KEPT = f"SELECT *, sha256({SQUEEZED}) AS digest FROM documents"


def digested(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("digest", tx.digest(F.col("text")))


@query(f"SELECT digest, doc_id, source FROM ({KEPT}) QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id, source) = 1")
def dd_exact(spark, sf_dir):
    return dedup.exact_winners(digested(spark, sf_dir), ["doc_id", "source"]).select("digest", "doc_id", "source")


@query(f"SELECT digest, min(doc_id) AS doc_id, count(*) AS occurrences, count(*) > 1 AS repeated FROM ({KEPT}) GROUP BY digest")
def dd_upsert_min(spark, sf_dir):
    """Winners kept over three streamed batches, upserted into their buckets; the second batch is run twice, which changes nothing."""
    d = digested(spark, sf_dir).select("digest", "doc_id", "source")
    parts = jobs.arriving(spark, [d.filter(F.pmod(F.col("doc_id"), F.lit(3)) == i) for i in range(3)])
    pool = Winners(spark, "digest string, doc_id long, source string", "digest", ["doc_id", "source"], buckets=16)

    def upsert(batch, k):
        for _ in range(2 if k == 1 else 1):
            pool.upsert(batch, k)

    last = jobs.Job(spark, "upserts").each(parts, upsert)
    return pool.current(last).select("digest", "doc_id", "occurrences", (F.col("occurrences") > 1).alias("repeated"))


@query(f"""WITH d AS ({KEPT}), w AS (SELECT digest, arg_min(source, doc_id) AS source FROM d GROUP BY digest), c AS (SELECT digest, source, count(*) AS n FROM d GROUP BY digest, source)
SELECT c.digest, c.source, c.n - (c.source = w.source)::INT AS removed FROM c JOIN w ON c.digest = w.digest WHERE c.n - (c.source = w.source)::INT > 0""")
def dd_exact_aliases(spark, sf_dir):
    """Removed occurrences by digest and provenance; the canonical one is subtracted."""
    d = digested(spark, sf_dir)
    w = d.groupBy("digest").agg(F.min_by("source", "doc_id").alias("kept_source"))
    c = d.groupBy("digest", "source").agg(F.count("*").alias("n"))
    return c.join(w, "digest").select("digest", "source", (F.col("n") - F.col("source").eqNullSafe(F.col("kept_source")).cast("long")).alias("removed")).filter("removed > 0")


#: The shared tables hold no texts as near as this; every tenth document gets a revision with a word added.
REVISED = "SELECT doc_id, n_chars, text, source FROM documents UNION ALL SELECT doc_id + 1000000000, n_chars + 10, text || ' Addendum.', source FROM documents WHERE doc_id % 10 = 0"
SIGNATURES = f"""t AS (SELECT doc_id, n_chars, text, source, {TOKENS} AS t FROM ({REVISED})),
f AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN [array_to_string(t[i:i + 4], ' ') for i in generate_series(1, len(t) - 4)] WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM t),
h AS (SELECT doc_id, ('0x' || substr(sha256(s), 1, 8))::BIGINT AS hi, ('0x' || substr(sha256(s), 9, 8))::BIGINT AS lo FROM f),
v AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((hi >> {b}) & 1) AS h{b}, sum((lo >> {b}) & 1) AS l{b}" for b in range(32))} FROM h GROUP BY doc_id),
g AS (SELECT t.doc_id, t.n_chars, t.source, sha256(t.text) AS sha, coalesce(n, 0) AS features, coalesce({" + ".join(f"(2 * h{b} >= n)::BIGINT * {1 << b}" for b in range(32))}, 0)::BIGINT AS sim_hi, coalesce({" + ".join(f"(2 * l{b} >= n)::BIGINT * {1 << b}" for b in range(32))}, 0)::BIGINT AS sim_lo FROM t LEFT JOIN v ON t.doc_id = v.doc_id)"""
NEAR = "bit_count(xor(a.sim_hi, b.sim_hi)) + bit_count(xor(a.sim_lo, b.sim_lo)) <= 3"
#: One node for each distinct set of shingles, under its smallest document.
SETS = f"""{SIGNATURES}, z AS (SELECT doc_id, sha256(string_agg(s, chr(30) ORDER BY s)) AS set_id FROM f GROUP BY doc_id),
u AS (SELECT min(g.doc_id) AS id, any_value(sim_hi) AS sim_hi, any_value(sim_lo) AS sim_lo, any_value(features) AS features FROM g JOIN z USING (doc_id) WHERE features >= 8 GROUP BY set_id)"""
SHARES = """i AS (SELECT p.a, p.b, count(*) AS n FROM p JOIN f x ON x.doc_id = p.a JOIN f y ON y.doc_id = p.b AND x.s = y.s GROUP BY p.a, p.b)"""


def signed(spark, sf_dir, sets=True, packed=False):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "text", "source")
    revised = d.filter("doc_id % 10 = 0").select(F.col("doc_id") + 1_000_000_000, F.col("n_chars") + 10, F.concat("text", F.lit(" Addendum.")), "source")
    return dedup.signatures(d.union(revised), sets=sets, packed=packed)


def _set_nodes(spark, sf_dir, hashes=False):
    """Distinct sets of eight shingles or more, under their smallest document; beside them, if asked for, the sets themselves by document.

    Signatures are written before they are filtered (a filter under which they are made would make them twice), and nodes are found without the sets.
    """
    d = signed(spark, sf_dir).select("doc_id", "features", "set_id", "sim_hi", "sim_lo", *(["hashes"] if hashes else []))
    d = staged(d, "signatures").filter("features >= 8").withColumnRenamed("doc_id", "rank")
    first = d.groupBy("set_id").agg(F.min(F.struct("rank", "sim_hi", "sim_lo")).alias("m")).select("set_id", "m.*")
    nodes = staged(first.dropDuplicates(["rank"]), "set-nodes")
    return (nodes, d.select("rank", "set_id", "hashes")) if hashes else nodes


@query(f"WITH {SIGNATURES} SELECT doc_id, features, sim_hi, sim_lo FROM g")
def dd_simhash(spark, sf_dir):
    return signed(spark, sf_dir, sets=False).select("doc_id", "features", "sim_hi", "sim_lo")


@query(f"WITH {SETS} SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND {NEAR}")
def dd_lsh_pairs(spark, sf_dir):
    """Pairs of distinct shingle sets whose signatures are within 3 bits, each by its smallest document."""
    return dedup.band_pairs(_set_nodes(spark, sf_dir)).select("a", "b")


@query(f"""WITH {SETS}, p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND {NEAR}), {SHARES}
SELECT p.a, p.b, round(coalesce(n, 0) / (x.features + y.features - coalesce(n, 0)), 6) AS jaccard, coalesce(n, 0) / (x.features + y.features - coalesce(n, 0)) >= 0.95 AS near FROM p LEFT JOIN i USING (a, b) JOIN u x ON x.id = p.a JOIN u y ON y.id = p.b""")
def dd_jaccard_verify(spark, sf_dir):
    """Jaccard of the whole shingle sets of candidate pairs; 0.95 decides."""
    nodes, sets = _set_nodes(spark, sf_dir, hashes=True)
    pairs = staged(dedup.band_pairs(nodes).select("a", "b"), "candidate-pairs")
    # Whole sets are brought to the pairs only.
    ranks = staged(pairs.select(F.col("a").alias("rank")).union(pairs.select("b")).distinct(), "candidate-ranks")
    sets = dedup.of_ranks(sets, ranks).join(nodes.select("rank", "set_id").hint("merge"), ["rank", "set_id"], "left_semi").dropDuplicates(["rank"])
    return dedup.jaccard(pairs, sets).select("a", "b", F.round("jaccard", 6).alias("jaccard"), (F.col("jaccard") >= 0.95).alias("near"))


def _ranked(spark, sf_dir):
    """Documents in the order of processing: longest first, then text hash, id and source; whether near deduplication applies. With them, what a walk reads."""
    d = signed(spark, sf_dir, packed=True).withColumn("code", filters.code_like(F.col("text"), F.col("source"))).withColumn("sha", F.sha2("text", 256)).drop("text")
    d = staged(d.withColumn("able", ~F.col("code") & (F.col("features") >= 8)).withColumn("size", (F.octet_length("hashes") / 8).cast("int")).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    order = [F.desc("n_chars"), "sha", "doc_id", "source"]
    narrow = d.drop("hashes", "features")
    ranked = staged(global_rank(narrow, [*order, "row"], "rank").drop("n_chars", "sha", "source"), "near-ranked")
    state = dedup.near_state(ranked, d.select("row", "hashes"))
    release(d)
    return ranked, state


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, sha256(text), doc_id, source) - 1 AS near_rank FROM documents")
def dd_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("sha"))
    return global_rank(d, [F.desc("n_chars"), "sha", "doc_id", "source"], "r").select("doc_id", (F.col("r") - 1).alias("near_rank"))


WALK = f"""{SIGNATURES}, z AS (SELECT doc_id, sha256(string_agg(s, chr(30) ORDER BY s)) AS set_id FROM f GROUP BY doc_id), {CODE.replace("FROM documents", f"FROM ({REVISED})")},
o AS (SELECT g.doc_id, set_id, sim_hi, sim_lo, features, code_like AS code, row_number() OVER (ORDER BY n_chars DESC, sha, g.doc_id, source) AS rank FROM g LEFT JOIN z USING (doc_id) JOIN cl USING (doc_id)),
able AS (SELECT * FROM o WHERE NOT code AND features >= 8),
near AS (SELECT a.rank AS a, b.rank AS b, a.doc_id AS x, b.doc_id AS y, a.features + b.features AS n FROM able a JOIN able b ON a.rank < b.rank AND {NEAR}),
e AS (SELECT a, b FROM near JOIN f p ON p.doc_id = x JOIN f q ON q.doc_id = y AND p.s = q.s GROUP BY a, b, n HAVING count(*) >= 0.95 * (n - count(*))),
nb AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM e GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT nb.i, CASE WHEN len([x for x in nb.earlier if NOT list_contains(walk.gone, x)]) > 0 THEN list_append(walk.gone, nb.b) ELSE walk.gone END FROM walk JOIN nb ON nb.i = walk.i + 1),
res AS (SELECT o.*, NOT list_contains((SELECT arg_max(gone, i) FROM walk), rank) AS kept FROM o)"""


@query(f"WITH RECURSIVE {WALK} SELECT doc_id, rank, kept FROM res")
def dd_near(spark, sf_dir):
    """Greedy near deduplication in rank order: a document goes iff an earlier kept one matches it."""
    ranked, state = _ranked(spark, sf_dir)
    return dedup.near_keep(ranked, state=state).join(ranked.select("rank", "doc_id").hint("merge"), "rank").select("doc_id", "rank", "kept")


@query(f"""WITH RECURSIVE {WALK} SELECT (SELECT count(*) FROM res) AS documents, (SELECT count(*) FROM res WHERE kept) AS retained, (SELECT count(*) FROM res WHERE NOT kept) AS removed, (SELECT count(*) FROM res WHERE code) AS code_bypass,
(SELECT count(*) FROM near JOIN res ON rank = a WHERE kept) AS candidate_checks, (SELECT count(*) FROM e JOIN res ON rank = a WHERE kept) AS matches""")
def dd_near_audit(spark, sf_dir):
    """What the walk kept and removed, and how many later documents its kept ones are compared with (within 3 bits) and match."""
    ranked, state = _ranked(spark, sf_dir)
    kept = staged(dedup.near_keep(ranked, state=state), "near-kept")
    able, nodes = ranked.filter("able"), state.nodes
    # Members of a set are counted, not paired: later members for each kept node and set.
    both = dedup.kept_pairs(state, kept.filter("kept").select("rank"))
    own = kept.filter("kept").join(nodes.select("rank").hint("merge"), "rank", "left_semi").select(F.col("rank").alias("a"), F.col("rank").alias("b"), F.lit(True).alias("near"))
    members = able.select("set_id", F.col("rank").alias("member")).join(nodes.select("set_id", F.col("rank").alias("b")).hint("merge"), "set_id")
    met = both.union(own).join(members.hint("merge"), "b").filter(F.col("member") > F.col("a"))
    checks = met.agg(F.count("*").alias("candidate_checks"), F.count_if("near").alias("matches"))
    k = kept.join(ranked.select("rank", "code").hint("merge"), "rank")
    return k.agg(F.count("*").alias("documents"), F.count_if("kept").alias("retained"), F.count_if(~F.col("kept")).alias("removed"), F.count_if("code").alias("code_bypass")).crossJoin(F.broadcast(checks))


ENTRY = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
#: The denylist: all benchmark items, and the first eight words of every fourth as short entries.
DENY = r"deny AS (SELECT text FROM benchmark UNION ALL SELECT array_to_string(string_split_regex(trim(text), '\s+')[1:8], ' ') FROM benchmark WHERE item_id % 4 = 0)"
NORMAL = f"array_to_string({TOKENS}, ' ')"


def _denylist(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    cut = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 8), " ")
    return b.select("text").union(b.filter("item_id % 4 = 0").select(cut))


def _shingled(table_name, key):
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(t) >= 5 THEN [array_to_string(t[i:i + 4], ' ') for i in generate_series(1, len(t) - 4)] WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM (SELECT {key}, {TOKENS} AS t FROM {table_name})"""


COVER = f"""WITH d AS ({_shingled("documents", "doc_id")}), e AS ({_shingled("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n FROM e GROUP BY item_id),
c AS (SELECT d.doc_id, e.item_id, count(*) / any_value(n.n) AS cover FROM d JOIN e ON d.s = e.s JOIN n ON n.item_id = e.item_id GROUP BY d.doc_id, e.item_id HAVING count(*) >= 0.9 * any_value(n.n))"""
FORMS = f"""{DENY}, en AS (SELECT DISTINCT {NORMAL} AS text FROM deny), es AS ({_shingled("(SELECT text AS entry, text FROM en)", "entry")}), ec AS (SELECT entry, count(*) AS n FROM es GROUP BY entry),
shorts AS (SELECT entry FROM ec WHERE n < 8), longs AS (SELECT entry, n FROM ec WHERE n >= 8)"""
SHORT_HITS = f"hs AS (SELECT d.doc_id, entry FROM (SELECT doc_id, {NORMAL} AS t FROM documents) d JOIN shorts ON contains(d.t, entry))"
SCREEN = f"""WITH {FORMS}, ds AS ({_shingled("documents", "doc_id")}), {SHORT_HITS},
an AS (SELECT entry, s FROM (SELECT entry, s, n, row_number() OVER (PARTITION BY entry ORDER BY ('0x' || substr(sha256(s), 1, 15))::BIGINT, s) AS k FROM es JOIN longs USING (entry)) WHERE k <= floor(0.1 * n + 1e-9) + 1),
cand AS (SELECT DISTINCT doc_id, entry FROM ds JOIN an USING (s)),
hl AS (SELECT doc_id, entry FROM cand JOIN ds USING (doc_id) JOIN es USING (entry, s) JOIN longs USING (entry) GROUP BY doc_id, entry, n HAVING count(*) >= 0.9 * n),
hits AS (SELECT doc_id, 0 AS o, entry FROM hs UNION ALL SELECT doc_id, 1, entry FROM hl),
firsts AS (SELECT doc_id, o, entry FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, entry) = 1)"""


@query(f"WITH {FORMS}, {SHORT_HITS} SELECT doc_id, count(*) AS entries, min(entry) AS first_entry FROM hs GROUP BY doc_id")
def dc_exact_short(spark, sf_dir):
    """Short denylist entries (under eight shingles) that occur in a document's normal form as a substring."""
    forms = _denylist(spark, sf_dir).select(contamination.normalised(F.col("text")).alias("text")).distinct()
    short = tx.with_shingles(forms, 5).filter((F.size("s") < 8) & (F.col("text") != "")).select(F.col("text").alias("entry"))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", contamination.normalised(F.col("text")).alias("t"))
    return contamination.contained(d, short).groupBy("doc_id").agg(F.count("*").alias("entries"), F.min("entry").alias("first_entry"))


@query(f"{COVER} SELECT doc_id, item_id, round(cover, 6) AS cover FROM c")
def dc_shingle_cover(spark, sf_dir):
    c = contamination.shingle_cover(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "item_id", F.round("cover", 6).alias("cover"))


@query(f"{SCREEN} SELECT d.doc_id, firsts.doc_id IS NULL AS kept, CASE o WHEN 0 THEN 'short' WHEN 1 THEN 'long' END AS kind, entry FROM documents d LEFT JOIN firsts USING (doc_id)")
def dc_screen(spark, sf_dir):
    """Every document with its verdict; contaminated ones go, with the first entry that matched."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    first, _ = contamination.screen(d, _denylist(spark, sf_dir))
    bad = first.select(F.col("doc_id").alias("_id"), "kind", "entry").hint("merge")
    return d.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", F.col("kind").isNull().alias("kept"), "kind", "entry")


@query(f"""{SCREEN} SELECT (SELECT count(*) FROM documents) AS input_documents, (SELECT count(*) FROM en WHERE text <> '') AS entries, (SELECT count(*) FROM shorts) AS short_entries, (SELECT count(*) FROM firsts) AS removed_documents,
(SELECT count(DISTINCT entry) FROM firsts) AS matched_entries, (SELECT count(*) FROM cand) AS candidate_checks, (SELECT count(*) FROM documents) - (SELECT count(*) FROM firsts) AS retained_documents""")
def dc_audit(spark, sf_dir):
    return contamination.screen(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), _denylist(spark, sf_dir))[1]


@query(f"SELECT {ENTRY} AS prompt, min(text) AS representative, count(*) AS entries FROM benchmark GROUP BY 1")
def dc_denylist_dedup(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("prompt", tx.canonical_prompt(F.col("text")))
    return b.groupBy("prompt").agg(F.min("text").alias("representative"), F.count("*").alias("entries"))


@query("""WITH p AS (SELECT conv_id, text FROM conversations WHERE role = 'user'), held AS (SELECT DISTINCT text FROM p WHERE conv_id % 10 = 0)
SELECT conv_id, count(*) AS prompts FROM p WHERE conv_id % 10 <> 0 AND conv_id NOT IN (SELECT conv_id FROM p JOIN held ON p.text = held.text) GROUP BY conv_id""")
def dc_ngram_guard(spark, sf_dir):
    """Training conversations that share no prompt with the held-out ones."""
    p = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", F.sha2("text", 256).alias("h"))
    held = p.filter("conv_id % 10 = 0").select("h").distinct()
    train = p.filter("conv_id % 10 <> 0")
    return train.join(train.join(held, "h", "left_semi").select("conv_id").distinct(), "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("prompts"))


@query("SELECT semantic, min(conv_id) AS conv_id, count(*) AS copies FROM (SELECT conv_id, sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY turn)) AS semantic FROM conversations GROUP BY conv_id) GROUP BY semantic")
def dd_semantic(spark, sf_dir):
    """Conversations by the hash of their messages alone."""
    return _semantic(table(spark, sf_dir, "conversations")).groupBy("semantic").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))


def _semantic(conversations):
    m = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return m.select("conv_id", F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\x1f"), x["text"])), "\x1e"), 256).alias("semantic"))


@query(f"SELECT count(DISTINCT digest) AS blobs, count(*) AS rows, sum(n) FILTER (WHERE k = 1)::BIGINT AS unique_chars FROM (SELECT digest, n_chars AS n, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS k FROM ({KEPT}))")
def dd_content_store(spark, sf_dir):
    d = digested(spark, sf_dir).groupBy("digest").agg(F.count("*").alias("c"), F.min_by("n_chars", "doc_id").alias("n"))
    return d.agg(F.count("*").alias("blobs"), F.sum("c").alias("rows"), F.sum("n").alias("unique_chars"))


