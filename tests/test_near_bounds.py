"""Size cells and sketches leave out only pairs that can't match."""

import random

from loamworks.operators import dedup
from loamworks.sources.stages import staged


def test_keys_of_size_cells_and_matches_by_sketch(spark):
    rnd = random.Random(3)
    base = [{rnd.getrandbits(64) - (1 << 63) for _ in range(n)} for n in (8, 19, 20, 21, 60, 400, 410)]
    sets = base + [set(list(s)[: len(s) - k]) for s in base for k in (1, len(s) // 20, len(s) // 15)] + [set(list(s)[1:]) | {k} for k, s in enumerate(base)]
    rows = staged(spark.createDataFrame([(i, sorted(s), len(s), 1, 2) for i, s in enumerate(sets)], "rank long, hashes array<long>, size int, sim_hi long, sim_lo long"), "sets")
    every = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    want = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= 0.95 * len(sets[a] | sets[b])}
    pairs = spark.createDataFrame(every, "a long, b long")
    assert {tuple(r) for r in dedup.matching(pairs, rows, dedup.sketched(rows), 0.95).collect()} == want and len(want) > 10
    keys = dedup.band_keys(rows, 3, 0.95).select("rank", "key").collect()
    of = {}
    for r in keys:
        of.setdefault(r["rank"], set()).add(r.key)
    met = {(a, b) for a, b in every if of.get(a, set()) & of.get(b, set())}
    assert want <= met and len(met) < len(every) / 2  # without cells all of one signature meet
