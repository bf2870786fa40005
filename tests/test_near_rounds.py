"""The walk of near deduplication takes no round for each document under a key, and leads go first where pairs are many."""

import random

from loamworks.operators import dedup

KIND = "rank long, able boolean, sim_hi long, sim_lo long, hashes array<long>, set_id string"


def plain_kept(rows):
    kept = []
    for rank, able, hi, lo, s, _ in sorted(rows):
        near = any((hi ^ a).bit_count() + (lo ^ b).bit_count() <= 3 and len(set(s) & set(t)) >= 0.95 * len(set(s) | set(t)) for _, a, b, t in kept if able)
        if able and not near:
            kept.append((rank, hi, lo, s))
    return {k[0] for k in kept} | {r[0] for r in rows if not r[1]}


def test_documents_under_one_key_are_met_at_once(spark, monkeypatch):
    """Forty sets under one signature, none like another: one after the other they took forty rounds."""
    rows = [(i, True, 5, 9, list(range(100 * i, 100 * i + 20)), str(i)) for i in range(40)]
    rows.append((40, True, 5, 8, [*range(0, 20), 7000], "40"))
    written, staged = [], dedup.staged
    monkeypatch.setattr(dedup, "staged", lambda df, name: written.append(name) or staged(df, name))
    got = {r["rank"] for r in dedup.near_keep(spark.createDataFrame(rows, KIND)).filter("kept").collect()}
    assert got == plain_kept(rows) == set(range(40)) and len(written) < 20


def test_leads_first_where_pairs_are_many(spark, monkeypatch):
    """Groups of near copies, of which leads leave few; nothing is met at once before they have gone."""
    rnd = random.Random(1)
    rows = []
    for g in range(3):
        base, sig = rnd.sample(range(10_000 * g, 10_000 * g + 5000), 80), rnd.getrandbits(64)
        for _ in range(25):
            s = sorted({*rnd.sample(base, rnd.choice((80, 79, 78, 76))), *rnd.sample(range(50_000, 50_004), rnd.choice((0, 0, 1, 2)))})
            x = sig ^ (1 << rnd.randrange(64)) if rnd.random() < 0.5 else sig
            rows.append((x >> 32, x & 0xFFFFFFFF, s))
    rnd.shuffle(rows)
    first = {}
    rows = [(i, rnd.random() < 0.95, *first.setdefault(str(s), (hi, lo)), s, str(s)) for i, (hi, lo, s) in enumerate(rows)]
    monkeypatch.setattr(dedup, "PAIRS", 20)
    monkeypatch.setattr(dedup, "PAIRS_A_ROW", 0)
    written, staged = [], dedup.staged
    monkeypatch.setattr(dedup, "staged", lambda df, name: written.append(name) or staged(df, name))
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    got = {r["rank"] for r in dedup.near_keep(docs).filter("kept").collect()}
    assert got == plain_kept(rows) and 3 < len(got) < 60 and "near-met" in written
