"""Operators that SQL can't express against plain Python, and all of them on awkward rows."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamworks import registry
from loamworks.functions import text as tx
from loamworks.functions.quantiles import quantiles
from loamworks.functions.ranks import global_rank, rank_within
from loamworks.operators import contamination, dedup, filters, ordering, rendering, retrieval, sampling
from loamworks.operators.scoring import pass_hat, same_calls, sign_test
from loamworks.sources import sinks
from loamworks.sources.pools import Winners


def test_quality_reasons(spark):
    long = "\n".join(f"line number {i} is long enough" for i in range(12))
    texts = {"short": "too_short", long: None, "x\n" * 150: None, ("a line of over twenty characters\n" * 9): "repetitive", "a" * 300 + "\x01" * 9: "control_characters", "a" * 300 + "�" * 2: "replacement_characters", "a\r\n" * 2_000_000: "too_long"}
    df = spark.createDataFrame([(t, r) for t, r in texts.items()], "text string, want string")
    rows = filters.with_reject_reason(df).collect()
    assert [r.reject_reason for r in rows] == [r.want for r in rows]
    assert filters.with_reject_reason(spark.createDataFrame([(None,)], "text string")).first().reject_reason is None


def test_privacy(spark):
    texts = ["mail a.b@c.org now", "password: hunter22", "ssn 123-45-6789", "tel: +49 (0) 123 456 789", "card 4111 1111 1111 1111 ok", "card 4111 1111 1111 1112", "0000000000000000", "a@b", ""]
    want = [["email"], ["labeled_secret"], ["ssn"], ["labeled_phone"], ["payment_card"], [], [], [], []]
    df = spark.createDataFrame([(i, t, i // 3) for i, t in enumerate(texts)], "i int, text string, g int")
    assert [list(r.r) for r in df.select(filters.privacy_reasons(F.col("text")).alias("r")).collect()] == want
    kept = filters.exclude_groups(df.withColumn("r", filters.privacy_reasons(F.col("text"))), "g", F.col("r"))
    assert {r.g for r in kept.collect()} == {2}


def test_source_family_and_prompts(spark):
    names = {"hf://datasets/a/b/c": "dataset:a/b", "https://User@WWW.x.org:80/p": "web:www.x.org", "s3://k/v": "scheme:s3", "dir/f.JSON": "file:.json", "dir/f": "file:no-extension", "name": "named:name", "n" * 200: None}
    got = {r.s: r.f for r in spark.createDataFrame([(n,) for n in names], "s string").select("s", filters.source_family(F.col("s")).alias("f")).collect()}
    assert all(got[n] == w for n, w in names.items() if w) and len(got["n" * 200]) == 160
    odd = "  ﬁx　ＡB\n c "
    assert spark.createDataFrame([(odd,)], "t string").select(tx.canonical_prompt(F.col("t")).alias("p")).first().p == " ".join(unicodedata.normalize("NFKC", odd).lower().split())


def test_code_like(spark):
    code = "import os\nx = {\n};\nconst y = 1\n"
    rows = [(code, "a", None, True), ("plain text", "b.py", None, True), ("plain text", "b", None, False), ("t", "dir/App.VUE", None, True), ("t", "data.json", None, False), ("t", "https://x.org/a/b.ts?raw=1", None, True), ("t", "https://x.org.py/a", None, False), ("t", "hf://GitHub-files", None, True), ("t", "x", "StarCoder en", True), (None, None, None, False), ("t", ".py", None, False)]
    df = spark.createDataFrame(rows, "t string, s string, p string, want boolean")
    got = df.select(filters.code_like(F.col("t"), F.col("s"), F.col("p")).alias("c"), "want").collect()
    assert [r.c for r in got] == [r.want for r in got]


def test_groups_with_any_reason_go_whole(spark):
    rows = [("a", ["email"]), ("a", []), ("b", []), (None, []), ("c", ["ssn", "email"]), ("b", [])]
    df = spark.createDataFrame(rows, "g string, r array<string>")
    assert Counter(r.g for r in filters.exclude_groups(df, "g", F.col("r")).collect()) == {"b": 2, None: 1}
    assert Counter(r.g for r in filters.exclude_groups(df.union(spark.createDataFrame([(None, ["ssn"])], df.schema)), "g", F.col("r")).collect()) == {"b": 2}


def test_exact_winners_of_nulls_ties_and_repeats(spark):
    rows = [("x", 3, "s"), ("x", 1, "s"), ("x", 1, "s"), ("x", None, "b"), (None, 5, "q"), (None, 4, "q"), (None, 4, "q"), ("y", None, None), ("y", None, None)]
    df = spark.createDataFrame(rows, "digest string, i int, s string")
    assert sorted(map(tuple, dedup.exact_winners(df, ["i", "s"]).collect()), key=str) == sorted([("x", None, "b"), (None, 4, "q"), ("y", None, None)], key=str)
    assert dedup.exact_winners(df.limit(0), ["i"]).count() == 0


def plain_walk(nodes, distance=3, share=0.95):
    """nodes [(able, signature, set)] in rank order -> whether each is kept, as told: gone iff an earlier kept one matches."""
    kept = []
    for i, (able, sig, s) in enumerate(nodes):
        gone = able and any(k and nodes[j][0] and bin(sig ^ nodes[j][1]).count("1") <= distance and len(s & nodes[j][2]) >= share * len(s | nodes[j][2]) for j, k in enumerate(kept))
        kept.append(not gone)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_near_walk_equals_the_plain_one_with_equal_signatures(spark, seed):
    """Few signatures, many sets under each: chains, stars, copies and sets that only meet under another's signature."""
    rnd = random.Random(seed)
    base = [set(rnd.sample(range(10_000), 60)) for _ in range(3)]
    sigs = [rnd.getrandbits(64) for _ in range(3)]
    nodes = []
    for _ in range(90):
        b = rnd.randrange(3)
        s = set(base[b])
        for _ in range(rnd.randint(0, 5)):
            s.discard(rnd.choice(sorted(s)))
            s.add(20_000 + rnd.randrange(6))
        sig = sigs[b] ^ sum(1 << k for k in rnd.sample(range(64), rnd.choice((0, 0, 0, 1, 2, 5))))
        nodes.append((rnd.random() < 0.9, sig, frozenset(s)))
    signed = lambda x: x - 2**63 * 2 if x >= 2**63 else x
    rows = [(i, able, sig >> 32, sig & 0xFFFFFFFF, sorted(s), str(sorted(s))) for i, (able, sig, s) in enumerate(nodes)]
    # Equal sets have equal signatures, as those computed from them do.
    first = {}
    rows = [(i, a, *first.setdefault(k, (hi, lo)), s, k) for i, a, hi, lo, s, k in rows]
    nodes = [(a, (hi << 32) | lo, frozenset(s)) for _, a, hi, lo, s, _ in rows]
    df = spark.createDataFrame(rows, "rank long, able boolean, sim_hi long, sim_lo long, hashes array<long>, set_id string").repartition(5)
    got = {r["rank"]: r.kept for r in dedup.near_keep(df).collect()}
    want = plain_walk(nodes)
    assert [got[i] for i in range(len(nodes))] == want and 5 < sum(want) < 85


def test_signatures_of_texts(spark):
    from hashlib import sha256

    texts = [" ".join(f"w{i}" for i in range(40)), "one", "", None, "A b  c d e F g"]
    got = dedup.signatures(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        toks = (t or "").lower().split()
        s = {" ".join(toks[i : i + 5]) for i in range(len(toks) - 4)} or ({" ".join(toks)} if toks else set())
        hs = [int.from_bytes(sha256(x.encode()).digest()[:8], "big") for x in s]
        sim = sum((2 * sum(h >> b & 1 for h in hs) >= len(hs)) << b for b in range(64)) if hs else 0
        assert (r.sim_hi << 32 | r.sim_lo) == sim and max(r.features, 0) == len(hs) and sorted(h % 2**64 for h in r.hashes or []) == sorted(hs)


def test_band_pairs_find_all_within_three_bits(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    sigs = base + base[:3] + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 4))) for b in base for _ in range(2)]
    df = spark.createDataFrame([(i, s >> 32, s & 0xFFFFFFFF) for i, s in enumerate(sigs)], "rank long, sim_hi long, sim_lo long")
    want = {(i, j) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if bin(sigs[i] ^ sigs[j]).count("1") <= 3}
    assert sorted((r.a, r.b) for r in dedup.band_pairs(df).collect()) == sorted(want)


def test_components_and_sides(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, "d")]
    got = ordering.component_sides(spark.createDataFrame(rows, "row_id long, key string"), "row_id", "key", 50).collect()
    assert {r.row_id: r.label for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5} and all(len({r.side for r in got if r.label == k}) == 1 for k in (1, 5))


@pytest.mark.parametrize("seed", range(4))
def test_capped_select_equals_the_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"h{rnd.random()}", rnd.choice((None, 1, 2, 3, 4, 5, 6)), rnd.choice((0, 0, 0, 1, None))) for i in range(60)]
    c, t, state, n, most = Counter(), Counter(), {}, 0, 18 if seed else 500
    for i, _, a, b in sorted(rows, key=lambda r: r[1]):
        state[i] = "cut" if n == most else "cluster_full" if c[a] >= 4 else "template_full" if t[b] >= 8 else "taken"
        if state[i] == "taken":
            c[a], t[b], n = c[a] + 1, t[b] + 1, n + 1
    df = spark.createDataFrame(rows, "i long, h string, a int, b int")
    assert {r.i: r.state for r in ordering.capped_select(df, ["h", "i"], "a", "b", 4, 8, most, n, len(+c)).collect()} == state
    if not seed:
        with pytest.raises(ValueError):
            ordering.capped_select(df, ["h", "i"], "a", "b", 4, 8, most, n + 1)
        assert ordering.capped_select(df.limit(0), ["h", "i"], "a", "b", 4, 8, most).count() == 0


def test_greedy_cover_equals_the_loop(spark):
    rnd = random.Random(2)
    hs = [f"{rnd.random():.12f}" for _ in range(40)]
    rows = [(i, hs[i], f"s{s}") for i in range(40) for s in rnd.sample(range(15), 3)]
    h, sets = {i: x for i, x, _ in rows}, defaultdict(set)
    for i, _, s in rows:
        sets[i].add(s)
    left, want = set.union(*sets.values()), []
    while left:
        best = min(sets, key=lambda i: (-len(sets[i] & left), h[i], i))
        want.append(best)
        left -= sets[best]
    fill = sorted((i for i in sets if i not in want), key=lambda i: (h[i], i))[: 20 - len(want)]
    df = spark.createDataFrame(rows, "row_id long, h string, stratum string")
    got = ordering.greedy_cover(df, 20).orderBy("pos").collect()
    assert [(r.row_id, r.kind) for r in got] == sorted([(i, "cover") for i in want] + [(i, "fill") for i in fill]) and [r.pos for r in got] == list(range(1, 21))
    with pytest.raises(ValueError):
        ordering.greedy_cover(df, 1)


def test_quota_order_and_spread(spark):
    rnd = random.Random(1)
    rows = [(i, f"s{min(rnd.randint(0, 5), rnd.randint(0, 5))}", f"{rnd.random():.12f}") for i in range(50)]
    got = [(r.i, r.s, r.pos) for r in ordering.quota_order(spark.createDataFrame(rows, "i long, s string, h string"), "s", "h", ["i"]).orderBy("pos").collect()]
    assert sorted(r[0] for r in got) == list(range(50)) and [r[2] for r in got] == list(range(1, 51))
    strata = {s for _, s, _ in rows}
    assert {s for _, s, _ in got[: len(strata)]} == strata
    again = ordering.quota_order(spark.createDataFrame(rows[::-1], "i long, s string, h string").repartition(5), "s", "h", ["i"])
    assert {(r.i, r.pos) for r in again.collect()} == {(i, p) for i, _, p in got}
    placed = ordering.spread(spark.createDataFrame(got, "i long, s string, pos long"), len(strata), 50).collect()
    assert sorted(r.place for r in placed) == list(range(50))


def test_containment_inside_words_and_short_entries(spark):
    docs = [(1, "xhello big worldy"), (2, "hello"), (3, "nothing"), (4, None), (None, "big o world"), (5, ""), (6, "a b"), (6, "llo a")]
    entries = ["hello big world", "hello", "o", "", "lo", "a b", "big o", "o big", " a", "world and more of it"]
    for limit, most in ((0, contamination.AUTOMATON_CHARS), (contamination.BROADCAST_ENTRIES, 0), (0, 0)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(contamination, "BROADCAST_ENTRIES", limit)
            got = {(r.doc_id, r.entry) for r in contamination.contained(spark.createDataFrame(docs, "doc_id long, t string"), spark.createDataFrame([(e,) for e in entries], "entry string"), most=most).collect()}
        assert got == {(d, e) for d, t in docs for e in entries if e and e in (t or "")}
    assert contamination.contained(spark.createDataFrame(docs, "doc_id long, t string"), spark.createDataFrame([("",)], "entry string")).count() == 0


def test_screening_records_the_first_entry_short_before_long(spark):
    """One entry of eight shingles and more, a short one, and one that two documents share; a copy with a tenth of its shingles lost."""
    long = " ".join(f"word{i}" for i in range(64))
    near = " ".join(f"word{i}" if i != 30 else "other" for i in range(64))
    far = " ".join(f"word{i}" if i not in (20, 40) else "other" for i in range(64))
    docs = [(1, f"lead {long} tail"), (2, near), (3, far), (4, "say The  Answer, please"), (5, f"the answer , {long}"), (6, None), (7, "clean text only"), (8, "z " + long.upper())]
    entries = [(long,), ("The answer,",), ("",), ("z z z word0 word1 word2 word3 word4 word5 word6 word7 word8 word9",), (None,)]
    first, audit = contamination.screen(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(entries, "text string"))
    z = entries[3][0]
    assert {(r.doc_id, r.kind, r.entry) for r in first.collect()} == {(1, "long", long), (2, "long", long), (4, "short", "the answer ,"), (5, "short", "the answer ,"), (8, "long", long)} and z > long
    a = audit.first()
    assert (a.input_documents, a.retained_documents, a.removed_documents, a.entries, a.short_entries, a.matched_entries) == (8, 3, 5, 3, 1, 2) and a.candidate_checks >= 5


def test_ngram_and_cosine_topk(spark):
    import zlib
    from math import sqrt

    texts = ["the quick brown fox", "quick brown foxes run", "unrelated words only", "", None, "The Quick  Brown Fox", "é中文 quick"] + [f"fox number {i} of the brown ones" for i in range(30)]
    asked = {9: "The Quick Brown Fox", 10: "number 7 fox", 11: None, 12: "中文"}

    def vector(t):
        t = f" {t.lower()} "
        return Counter(zlib.crc32(t[i : i + n].encode()) % 8192 for n in (3, 4, 5) for i in range(len(t) - n + 1))

    want = set()
    for q, t in asked.items():
        if t is not None:
            a, scores = vector(t), []
            for i, x in enumerate(texts):
                b = vector(x) if x is not None else {}
                dot = sum(a[d] * b.get(d, 0) for d in a)
                if dot:
                    scores.append((-round(dot / sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 6), i))
            want |= {(q, i, r + 1, -s) for r, (s, i) in enumerate(sorted(scores)[:4])}
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for block in (1000, 2):
        assert {(r.query_id, r.item_id, r["rank"], r.score) for r in retrieval.ngram_topk(queries, items, 4, block=block).collect()} == want
    assert retrieval.ngram_topk(queries.limit(0), items, 4).count() == 0


def test_quantiles_of_hot_tied_and_null_keys(spark):
    import numpy as np

    rnd = random.Random(4)
    rows = [(rnd.choice(("hot", "hot", "hot", None, "k")), rnd.choice((None, 1.0, 1.0, 2.5, rnd.random()))) for _ in range(500)] + [("one", 7.0), ("none", None)]
    got = {r.k: (r.a, r.b, r.c) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"a": 0.5, "b": 0.9, "c": 1.0}).collect()}
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    assert {k: pytest.approx(tuple(np.quantile(v, [0.5, 0.9, 1.0]))) for k, v in values.items()} == got


def test_packing_covers_everything(spark):
    docs = spark.createDataFrame([(i, n) for i, n in enumerate((0, 5, 40, 3, 16, 7))], "doc_id long, n int")
    got = rendering.pack(docs, ["doc_id"], F.col("n"), 16).orderBy("row", "start").collect()
    assert sum(r.tokens for r in got) == 71 + 6
    flat = [d for r in got for d in [r.doc_id] * r.tokens]
    assert flat == [d for d, n in enumerate((0, 5, 40, 3, 16, 7)) for _ in range(n + 1)] and all(r.start + r.tokens <= 16 for r in got)


def test_page_nodes_and_ranking(spark):
    page = "<html><head><title>t</title></head><body><nav>Menu</nav><div>Buy <b>red shoes</b> now<br>today</div><script>x()</script><a href=#>Red</a><p></body>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    nodes = {(r.tag, r.text) for r in rendering.page_nodes(pages).collect()}
    assert nodes == {("nav", "Menu"), ("div", "Buy nowtoday"), ("b", "red shoes"), ("a", "Red")}
    ranked = rendering.rank_nodes(rendering.page_nodes(pages), spark.createDataFrame([(1, "red shoes")], "page_id long, task string"), 16).orderBy("rank").collect()
    assert [r.tag for r in ranked] == ["b", "a"]
    assert rendering.page_text(pages, 10).collect()[0].text == "Menu Buy n"


def test_scoring_columns(spark):
    from math import comb

    df = spark.createDataFrame([(3, 5, 2), (0, 4, 1), (4, 4, 4), (1, 2, 3)], "s int, n int, k int")
    got = [r.p for r in df.select(pass_hat(F.col("s"), F.col("n"), F.col("k")).alias("p")).collect()]
    assert got == pytest.approx([comb(s, k) / comb(n, k) if n >= k else 0 for s, n, k in ((3, 5, 2), (0, 4, 1), (4, 4, 4), (1, 2, 3))])
    tail = spark.createDataFrame([(8, 2), (0, 0), (1, 9)], "w long, l long").select(sign_test(F.col("w"), F.col("l")).alias("p")).collect()
    assert [r.p for r in tail] == pytest.approx([56 / 1024, 1.0, 1023 / 1024])
    calls = "array<struct<name:string,args:int>>"
    m = spark.createDataFrame([([("a", 1), ("b", 2)], [("b", 2), ("a", 1)]), ([("a", 1)], [("a", 1), ("a", 1)]), ([], [])], f"g {calls}, p {calls}")
    assert [r.m for r in m.select(same_calls(F.col("g"), F.col("p")).alias("m")).collect()] == [True, False, True]


def test_global_rank_and_split(spark):
    rows = [(i, (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(6)
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.i: r.pos for r in global_rank(df, ["v", "i"], "pos").collect()} == want
    assert {r.i: r.before for r in global_rank(df, ["i"], "before", F.lit(1).cast("long")).collect()} == {i: i for i, _ in rows}
    total = global_rank(df, ["i"], "before", F.col("v"))
    assert {r.i: r.before for r in total.collect()} == {i: sum(v for j, v in rows if j < i) for i, _ in rows}
    n = Counter(r.split for r in sampling.exact_split(df, "i", 0.05, 1).collect())
    assert n == {"validation": 10, "train": 190}
    assert global_rank(df.limit(0), ["i"], "pos").count() == 0


def test_winners_over_batches_replays_and_failures(spark):
    """Winners equal those of all rows at once; only touched buckets are written; a batch run again, or after a failed attempt, changes nothing."""
    import os

    pool = Winners(spark, "k string, i long, v string", "k", ["i", "v"], buckets=8)
    rnd = random.Random(8)
    seen, batches = [], [[(rnd.choice(["a", "b", "c", None, f"k{rnd.randrange(9)}"]), rnd.randrange(50), f"v{rnd.randrange(9)}") for _ in range(n)] for n in (40, 0, 30)] + [[("a", 0, "v")]]
    schema = "k string, i long, v string"
    for n, batch in enumerate(batches):
        known = {r[0] for r in seen}
        df = spark.createDataFrame(batch, schema)
        if n == 2:  # an attempt that wrote other rows and died before its list
            spark.createDataFrame([("a", -1, "x", 1, 0)], pool.stored.replace("batch long, ", "")).write.partitionBy("bucket").parquet(f"{pool.path}/rows/batch=2")
        told = [pool.upsert(df, n) for _ in range(2)]
        seen += batch
        assert told[0] == told[1] and told[0]["added"] == len({r[0] for r in batch} - known)
        want = {(k, *min((i, v) for x, i, v in seen if x == k), sum(x == k for x, _, _ in seen)) for k in {r[0] for r in seen}}
        assert {tuple(r) for r in pool.current(n).collect()} == want
    assert len([d for d in os.listdir(f"{pool.path}/rows/batch=3") if d.startswith("bucket=")]) == told[0]["buckets"] == 1


def test_streams_of_empty_tables(spark, tmp_path):
    for name in ("events", "documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("ss_deadline_window", "ss_sessions", "ss_screen", "ss_pool", "dd_upsert_min"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_rank_within_hot_and_null_keys(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", (i * 7919) % 1009, i % 4) for i in range(1009)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    got = rank_within(df, "k", ["o"], "rank", "n").collect()
    assert sorted((r.rank, r.n, r.o) for r in got) == sorted((i + 1, len(g), r[1]) for g in groups.values() for i, r in enumerate(g))
    got = rank_within(df, "k", ["o"], "before", "sum", F.col("v")).collect()
    assert sorted((r.o, r.before, r.sum) for r in got) == sorted((r[1], sum(x[2] for x in g[:i]), sum(x[2] for x in g)) for g in groups.values() for i, r in enumerate(g))
    assert rank_within(df.limit(0), "k", ["o"], "rank", "n").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_serving_equals_the_plain_loop(spark, seed):
    rnd = random.Random(seed)
    a, b = ([x / sum(w) for x in w] for w in ([rnd.randint(0, 5) + (i == 0) for i in range(5)] for _ in range(2)))
    target, served, n = [0.0] * 5, [0] * 5, 60
    for step in range(n):
        target = [t + x + (y - x) * step / (n - 1) for t, x, y in zip(target, a, b)]
        owed = [t - s for t, s in zip(target, served)]
        served[next(i for i, d in enumerate(owed) if d >= max(owed) - 1e-9)] += 1
    one = spark.createDataFrame([([(f"s{i}", x, y) for i, (x, y) in enumerate(zip(a, b))],)], "s array<struct<source: string, a: double, b: double>>")
    got = one.select(F.inline(ordering.serve(F.col("s"), n))).collect()
    assert [r.served for r in got] == served and [r.target for r in got] == pytest.approx(target)


def test_views_sum_up_to_their_parent(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7), (4, None, 1), (4, "a", 5)], "i long, k string, n long")
    got = sinks.grouped_views(df, "k", {"x": ("a", "b")}, "view", ["n"]).groupBy("view").count().collect()
    assert {r.view: r["count"] for r in got} == {"x": 3, "c": 1, "none": 1}
    with pytest.raises(ValueError):
        sinks.grouped_views(df, "k", {"x": ("a",), "y": ("a",)}, "view", [])


def test_ranking_counts_all_ancestors_and_restores_page_order(spark):
    rnd = random.Random(12)
    task, pages, want = "red shoes size nine", [], {}
    for page in range(40):
        nodes, html = [], []

        def build(above, depth):
            mine = len(nodes)
            tag = rnd.choice(["div", "p", "a"]) if depth else "div"
            text = " ".join(rnd.choice([*task.split(), "blue", "hat", task]) for _ in range(rnd.randrange(4)))
            nodes.append((tag, above, text))
            html.append(f"<{tag}>{text}")
            for _ in range(rnd.randrange(4) if depth < 4 else 0):
                build([*above, mine], depth + 1)
            html.append(f"</{tag}>")

        build([], 0)
        pages.append((page, "".join(html)))
        goal, said = set(task.split()), [set(t.split()) & set(task.split()) for _, _, t in nodes]
        keys = []
        for k, (tag, above, text) in enumerate(nodes):
            if text or tag == "a":
                over = set().union(*[said[x] for x in above]) if above else set()
                keys.append((-(task in text), -len(said[k]), -len(over & goal), -(tag == "a"), k, len(text) + 1, tag))
        used, kept = 0, []
        for rank, key in enumerate(sorted(keys), 1):
            used += key[5]
            if used > 120:
                break
            kept.append((key[4], key[6], rank, -key[1], -key[2]))
        want[page] = [(*x, i) for i, x in enumerate(sorted(kept), 1)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = defaultdict(list)
    for r in rendering.rank_nodes(rendering.page_nodes(df), df.select("page_id", F.lit(task).alias("task")), 120).orderBy("page_id", "node").collect():
        got[r.page_id].append((r.node, r.tag, r["rank"], r.own, r.above, r.place))
    assert got == {k: v for k, v in want.items() if v}
