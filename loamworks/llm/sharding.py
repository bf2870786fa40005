"""Sharding by balanced label propagation, in DataFrame functions only.

Linked documents (here: those of one group) start spread evenly over the shards. Each round joins every document to
its group's members per shard and lets it ask for the shard with more neighbours than its own. Requests that face each other
are exchanged one for one, as are those along longer cycles of shards; the rest are admitted as far as the target shard has
room under its quota. Every admitted
move raises the sum of squares of its group's members per shard, so propagation comes to rest: rounds end when two in a row
(whose ties lean different ways) admit nothing. Documents without neighbours then fill the shards up to their exact row
quota, so that sizes differ by one row at most (law `rows`).

A group larger than a quota fills one shard after another, and isn't one task anywhere: counts per group and shard are
partial aggregates, ranks are taken within hash buckets, and rows that are alike in everything are numbered by ranges. Rows
are joined on a number of their own, never on a hash.

Nulls: null texts are equal to each other and have size 1; a null doc_id is a document as any other. Very long texts count
as one row; only their size and hashes are kept. Repeated rows are documents of their own. Ties between shards are broken by
a seeded hash. Empty table: an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank_within
from . import common

SHARDS = 16
SEED = 71


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (at + 1).cast("int"))


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _cycle(flows: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """A shortest cycle of shards with requests from each to the next; empty if there is none."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(k for k, v in flows.items() if v):
        after.setdefault(a, []).append(b)
    best: list[int] = []
    for start in after:
        paths, seen = [[start]], {start}
        while paths and (not best or len(paths[0]) < len(best)):
            path = paths.pop(0)
            if start in after.get(path[-1], ()):
                best = path
                break
            for b in after.get(path[-1], ()):
                if b not in seen:
                    seen.add(b)
                    paths.append([*path, b])
    return list(zip(best, best[1:] + best[:1]))


def _admissions(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the requests (from, to) are admitted: along cycles, which change no load, then as far as there is room."""
    left, room, out = dict(flows), list(room), {}
    while cycle := _cycle(left):
        n = min(left[k] for k in cycle)
        for k in cycle:
            left[k] -= n
            out[k] = out.get(k, 0) + n
    moved = True
    while moved:
        moved = False
        for (a, b), v in sorted(left.items(), key=lambda x: (-x[1], x[0])):
            n = min(v, room[b])
            if n:
                left[a, b] -= n
                out[a, b] = out.get((a, b), 0) + n
                room[a], room[b], moved = room[a] + n, room[b] - n, True
    return out


def propagate(linked: DataFrame, quotas: list[int], seed: int = SEED) -> DataFrame:
    """linked(row, key, grp) -> (row, key, grp, shard). row: unique; key: 60-bit order key; grp: the row's group. Shard loads stay within quotas."""
    shards = len(quotas)
    n = linked.count()
    ranked = common.running_total(linked, [], "key", ["row"], F.lit(1), "_r")
    shares = F.array(*[F.lit(float(sum(quotas[:s]))) for s in range(1, shards + 1)])
    scale = sum(quotas) / max(n, 1)
    start = F.size(F.filter(shares, lambda top: top <= (F.col("_r") * F.lit(scale)))).cast("int")
    state = common.materialise(ranked.select("row", "key", "grp", F.least(start, F.lit(shards - 1)).alias("shard")), "shard-state")
    idle, turn = 0, -1
    while True:
        turn += 1
        loads = _loads(state, shards)
        room = [q - x for q, x in zip(quotas, loads)]
        votes = state.groupBy("grp", "shard").agg(F.count("*").alias("n"))
        lean = F.xxhash64(F.lit(seed + turn), F.col("grp"), F.col("shard"))  # ties lean another way each round
        # A group's best shard: most members among shards with room; any shard with members is a candidate for exchange.
        asks = votes.groupBy("grp").agg(
            F.max(F.struct(F.when(_pick(room, F.col("shard")) > 0, 1).otherwise(0).alias("open"), "n", lean.alias("lean"), "shard")).alias("best"),
            F.max(F.struct("n", lean.alias("lean"), "shard")).alias("most"),
        )
        asks = asks.select("grp", F.when(F.col("best.open") == 1, F.col("best")).otherwise(F.struct(F.lit(0).alias("open"), F.col("most.n"), F.col("most.lean"), F.col("most.shard"))).alias("b"))
        here = votes.withColumnRenamed("n", "own").join(asks.hint("merge"), "grp")
        better = (F.col("b.n") > F.col("own")) | ((F.col("b.n") == F.col("own")) & (F.col("b.lean") > lean))
        here = here.filter((F.col("b.shard") != F.col("shard")) & better).select("grp", "shard", F.col("b.shard").alias("to"), "own", (F.col("b.n") - F.col("own")).alias("gain"))
        # Written, since both uses below read it, and so that the join of a hot group's rows has plain shuffles on both sides, which can be split.
        here = common.materialise(here, "shard-asks")
        flows = {(r.shard, r.to): r.n for r in here.groupBy("shard", "to").agg(F.sum("own").alias("n")).collect()}  # at most shards * shards rows
        admit = _admissions(flows, room)
        idle = 0 if admit else idle + 1
        if not flows or idle == 2:
            common.release(here)
            return state
        if idle:
            common.release(here)
            continue
        table = [admit.get((a, b), 0) for a in range(shards) for b in range(shards)]
        moving = state.join(here.select("grp", "shard", "to", "gain").hint("merge"), ["grp", "shard"])
        # Documents with more to gain go first (by powers of two), else in hash order: both are in the upper bits.
        level = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(31)).cast("long")
        moving = moving.withColumn("_o", F.shiftleft(31 - level, 55).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(seed + turn), "key"), 9)))
        moving = common.running_total(moving, ["shard", "to"], "_o", ["key", "row"], F.lit(1), "_r")
        moving = moving.filter(F.col("_r") < _pick(table, F.col("shard") * shards + F.col("to"))).select("row", F.col("to").alias("_to"))
        after = state.join(moving.hint("merge"), "row", "left").select("row", "key", "grp", F.coalesce("_to", "shard").alias("shard"))
        before, state = state, common.materialise(after, "shard-state")
        common.release(before, here)


def _keyed(slim: DataFrame, seed: int) -> DataFrame:
    """slim(row, doc_id, grp ...) with `key`: 60 bits of a hash of doc_id, group, and the number among rows alike in both."""
    alike = slim.groupBy("doc_id", "grp").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_d"), F.col("grp").alias("_g"))
    alike = common.materialise(alike, "shard-alike")
    if not alike.limit(1).count():
        return slim.withColumn("key", common.seeded_key(seed, F.col("doc_id"), F.col("grp"), F.lit(1)))
    same = slim.select("row", "doc_id", "grp").join(alike.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("grp") == F.col("_g")), "left_semi")
    same = same.select("row", F.concat_ws(":", "grp", F.col("doc_id").cast("string")).alias("like"))
    numbered = common.materialise(rank_within(same, "like", ["row"], "copy", "copies").select(F.col("row").alias("_row"), "copy"), "shard-copies")
    j = slim.join(numbered.hint("merge"), F.col("row") == F.col("_row"), "left")
    return j.withColumn("key", common.seeded_key(seed, F.col("doc_id"), F.col("grp"), F.coalesce("copy", F.lit(1)))).drop("_row", "copy")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, grp, shard, slot. Texts are read once; rows keep their own number."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.when(F.col("text").isNotNull(), F.sha2(F.col("text").cast("binary"), 256)).otherwise(F.lit("null")).alias("grp"))
    rows = common.materialise(slim.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    slim = common.materialise(_keyed(rows, seed), "shard-keys")
    common.release(rows)
    n = slim.count()
    if n == 0:
        return slim.select("doc_id", "size", "text_crc32", "grp", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    quotas = _quotas(n, shards)
    groups = common.materialise(slim.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select("grp"), "shard-groups")
    linked = common.materialise(slim.select("row", "key", "grp").join(groups.hint("merge"), "grp", "left_semi").select("row", "key", "grp"), "shard-linked")
    state = propagate(linked, quotas, seed)
    common.release(groups, linked)
    room = [q - x for q, x in zip(quotas, _loads(state, shards))]
    tops = F.array(*[F.lit(sum(room[: s + 1])).cast("long") for s in range(shards)])
    single = slim.select("row", "key").join(state.select("row").hint("merge"), "row", "left_anti")
    single = common.running_total(single, [], "key", ["row"], F.lit(1), "_r")
    single = single.select("row", "key", F.size(F.filter(tops, lambda top: top <= F.col("_r"))).cast("int").alias("shard"))
    placed = common.materialise(state.select("row", "key", "shard").unionByName(single), "shard-placed")
    common.release(state)
    slots = common.running_total(placed, ["shard"], "key", ["row"], F.lit(1), "slot").select("row", "shard", "slot")
    return slim.join(slots.hint("merge"), "row").select("doc_id", "size", "text_crc32", "grp", "shard", F.col("slot").cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {}
