import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamworks.llm import chat_format, mixing, sharding

from . import cases


def plain_targets(sizes, weights, total, cap):
    """Water-filling as told: clamp, share the excess by weight, until none is above."""
    target, fixed = {}, set()
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(cap * sizes[s] for s in fixed)
        target = {s: cap * sizes[s] if s in fixed else left * weights[s] / sum(weights[x] for x in free) for s in sizes}
        above = {s for s in free if target[s] > cap * sizes[s]}
        if not above:
            return target
        fixed |= above


@pytest.mark.parametrize("which", ["sf0.01", "awkward", "empty"])
def test_mixing(spark, which):
    docs = cases.documents(spark, "sf0.01") if which == "sf0.01" else spark.createDataFrame(cases.awkward() if which == "awkward" else [], cases.DOCS)
    rows = [(r.doc_id, len(cases.words(r.text)), r.source) for r in docs.collect()]
    got = mixing.plan(docs).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter(rows)
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = plain_targets(dict(sizes), {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2) if rows else {}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}


def test_mix_repeats_rows(spark):
    docs = cases.documents(spark, "sf0.001")
    plan = {r.doc_id: r.copies for r in mixing.plan(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixing.mix(docs).columns == docs.columns and got == Counter({d: n for d, n in plan.items() if n})


@pytest.mark.parametrize("weights", [(3.0, 1.0, 2.0), (1.0, 4.0)])
def test_mix_of_repeated_ids_and_clashing_columns(spark, weights):
    """Rows that share an id, or everything, are taken as often as the plan takes them in all; copies of a row differ by one at most."""
    rows = [(7, f"w{i % 3} " * (i % 4), f"s{i % 5}", "n", i, 1) for i in range(60)] + [(None, "same text", "s1", "n", 0, 1)] * 40 + [(None, None, None, "n", 0, 1)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n string, k long, times int")
    plan = mixing.plan(docs, weights=weights).collect()
    got = mixing.mix(docs, weights=weights)
    assert got.columns == docs.columns
    got = Counter(map(tuple, got.collect()))
    want = Counter()
    for r in plan:
        want[r.doc_id, r["size"], r.source] += r.copies
        assert r.copies <= 2
    have, of = Counter(), Counter(rows)
    for r, c in got.items():
        have[r[0], len(cases.words(r[1])), r[2]] += c
        assert c <= 2 * of[r]
    assert have == +want
    alike = [c / of[r] for r, c in got.items() if r[1] == "same text"]
    assert all(abs(c - want[None, 2, "s1"] / 40) < 1 for c in alike)


@pytest.mark.parametrize("which", ["sf0.01", "awkward", "empty", "hot", "hot and single", "all linked", "alike"])
def test_sharding(spark, which):
    if which == "hot and single":
        docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") / F.when(F.col("id") < 90, 4).otherwise(1)).cast("int"))).alias("text"))
    elif which == "hot":
        docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 4).cast("int"))).alias("text"))
    elif which == "alike":  # a third of the rows alike in everything, without id and text
        docs = spark.range(900).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("t"), (F.col("id") / 4).cast("int"))).alias("text"), F.lit("x").alias("row"), F.lit(1).alias("key"))
    elif which == "all linked":
        docs = spark.range(640).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 320).alias("text"))
    else:
        docs = cases.documents(spark, "sf0.01") if which == "sf0.01" else spark.createDataFrame(cases.awkward() if which == "awkward" else [], cases.DOCS)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, cases.crc(r.text)) for r in docs.collect())
    got = sharding.assign(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, groups = defaultdict(list), defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.grp].append(r.shard)
    loads = [len(slots[s]) for s in range(16)]
    assert max(loads) - min(loads) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    together = sum(max(Counter(x).values()) for x in groups.values() if len(x) > 1)
    linked = sum(len(x) for x in groups.values() if len(x) > 1)
    print(which, "linked", linked, "with most of their group", together)
    if which in ("sf0.01", "all linked"):
        assert together >= 0.9 * linked
    # Rows outside their group's main shard; a group of 300 rows must leave 244 outside one shard of 56 or 57.
    assert linked - together <= {"sf0.01": 0, "awkward": 2, "empty": 0, "hot": 300, "hot and single": 244, "all linked": 24, "alike": 300}[which]
    if which == "hot":  # no room beside the quotas: only exchanges are possible, which gather the group in a few shards
        top = sorted(Counter(groups[max(groups, key=lambda g: len(groups[g]))]).values())
        assert top[-1] >= 1.5 * 300 / 16
    if which == "hot and single":  # a group of a third of all rows fills five shards and part of a sixth
        top = sorted(Counter(groups[max(groups, key=lambda g: len(groups[g]))]).values())
        assert sum(top[-6:]) >= 0.9 * 300


def test_admissions_keep_loads_within_quotas():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(2, 6)
        flows = {(a, b): rnd.randint(1, 9) for a in range(n) for b in range(n) if a != b and rnd.random() < 0.4}
        room = [rnd.choice((0, 0, 3)) for _ in range(n)]
        admit = sharding._admissions(flows, room)
        into = [sum(v * ((b == s) - (a == s)) for (a, b), v in admit.items()) for s in range(n)]
        assert all(0 < v <= flows[k] for k, v in admit.items()) and all(i <= r for i, r in zip(into, room))
        left = {k: v - admit.get(k, 0) for k, v in flows.items()}
        assert not sharding._cycle(left) and not any(v and room[b] - into[b] for (_, b), v in left.items())
    assert sharding._cycle({(0, 1): 2, (1, 2): 1, (2, 0): 5, (2, 3): 1}) == [(0, 1), (1, 2), (2, 0)]


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be <s> & [INST]"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes &amp; no"), (1, 3, "user", None), (1, 4, "assistant", "]\n</s>"), (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, None, None, None), (4, 1, "assistant", "x" * 100_000), (4, 0, "user", "é🙂")]
    conv = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, formatted string, example int")
    ex = chat_format.format_examples(conv)
    read = ex.select("conv_id", "example", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"), "loss_chars")
    got = {(r.conv_id, r.example): ([(t.role, t.text) for t in r.turns], r.loss) for r in read.collect()}
    one = [(a, b or "") for c, _, a, b in rows if c == 1]
    assert got == {
        (1, 0): (one[:3], one[2][1]), (1, 1): (one, one[4][1]), (2, 0): ([("user", "only")], None), (3, 0): ([("assistant", "")], ""), (3, 1): ([("assistant", "")] * 2, ""),
        (None, 0): ([("", "")], None), (4, 0): ([("user", "é🙂"), ("assistant", "x" * 100_000)], "x" * 100_000),
    }
    assert chat_format.format_examples(conv.limit(0)).count() == 0


def test_chat_digest_of_awkward_texts(spark, tmp_path):
    rows = [(5, 0, "user", "a<b"), (5, 1, "assistant", "&lt;[x]"), (5, 2, "assistant", None), (5, 3, "user", "bye")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[5].turns_sha256 == sha("".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows)) and got[5].loss_sha256 == sha("&lt;[x]") and got[5].loss_chars == 7 and got[5].n_turns == 4
    both = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == sha(both) and got[-1].turns_sha256 == sha(f"user\n{both}\nassistant\n{both}\n")
