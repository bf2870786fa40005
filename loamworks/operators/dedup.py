"""Exact and near deduplication."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, ShortType, StringType, StructField, StructType

from ..functions import text as tx
from ..sources.stages import release, shared_dir, staged


def exact_winners(df: DataFrame, order: list[str], key: str = "digest") -> DataFrame:
    """One row per key, null being one too: the smallest by `order`; of rows alike in key and order, one.

    An aggregate over the ids decides, so that no key's rows meet in one task.
    """
    smallest = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = smallest.select(F.col(key).alias("_key"), *[F.col(f"_first.{c}").alias(f"_first_{c}") for c in order])
    same = F.col(key).eqNullSafe(F.col("_key"))
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_first_{c}"))
    return df.join(firsts, same, "left_semi").dropDuplicates([key, *order])


def _signature(size: int, sets: str | None):
    kind = StructType([StructField("features", LongType()), StructField("hi", LongType()), StructField("lo", LongType())])
    if sets:
        kind = kind.add("hashes", ArrayType(LongType()) if sets == "array" else BinaryType()).add("set_id", StringType())

    @F.pandas_udf(kind)
    def signature(given: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """Of token texts: number of shingles, majority bits as two halves, the sorted 64-bit values, and a digest of these."""
        for batch in given:
            for part in tx.pieces(batch):
                rows = []
                for x in part:
                    h = tx.shingle_hashes(tx.token_bytes(x), size)
                    ones = sum((np.unpackbits(h[i : i + 4096].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint16) for i in range(0, len(h), 4096)), np.zeros(64, np.int64))
                    hi, lo = np.packbits(2 * ones >= len(h)).view(">u4").tolist() if len(h) else (0, 0)
                    row = (len(h), hi, lo)
                    if sets:
                        s = np.sort(h.astype(np.int64))  # several times as fast as np.unique()
                        s = s[np.diff(s, prepend=~s[:1]) != 0]
                        row = (*row, s if sets == "array" else s.tobytes(), blake2b(s.tobytes(), digest_size=16).hexdigest())
                    rows.append(row)
                yield pd.DataFrame(rows, columns=kind.names)

    return signature


def signatures(docs: DataFrame, size: int = 5, sets: bool = True, packed: bool = False) -> DataFrame:
    """docs(text, ...) with the number of shingles `features`, a 64-bit SimHash as two 32-bit halves sim_hi and sim_lo and, unless
    `sets` is false, the shingles' 64-bit `hashes` (sorted; an array, or its bytes if `packed`) and `set_id`, a digest of these.

    Each shingle votes with the first 64 bits of its sha256; a bit is set when at least half of the votes are. Column functions
    take about ten times as long as numpy, hence the UDF; it works through a batch in pieces. Arrays take several times as long
    to write as their bytes.
    """
    df = docs.withColumn("_sim", _signature(size, ("packed" if packed else "array") if sets else None)(tx.token_text(F.col("text"))))
    out = {"features": "features", "sim_hi": "hi", "sim_lo": "lo"} | ({"hashes": "hashes", "set_id": "set_id"} if sets else {})
    return df.withColumns({c: F.col(f"_sim.{x}") for c, x in out.items()}).drop("_sim")


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def _masks(max_distance: int) -> list[tuple[int, int]]:
    """Masks (upper, lower half) of two of max_distance + 2 bands of 64 bits each. Signatures within max_distance bits share two bands at least."""
    bands = max_distance + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in two) for two in combinations(range(bands), 2)]
    return [(m >> 32, m & 0xFFFFFFFF) for m in masks]


def _part(col: str, mask: int) -> Column:
    return F.col(col).bitwiseAND(F.lit(mask).cast("long"))


def band_keys(nodes: DataFrame, max_distance: int = 3, min_jaccard: float | None = None) -> DataFrame:
    """nodes(rank, sim_hi, sim_lo), staged -> one row for each two bands (about 26 bits), of keys that two nodes have: rank, sim_hi, sim_lo, band, key.

    With min_jaccard, nodes have the size of their set too: a key is of one size cell, and a node is in its own cell and the next. Sets whose
    sizes allow that similarity are in one cell or in neighbouring ones, so they still share keys; most others no longer do.
    Only the keys of all nodes are shuffled; rows are shuffled where very many keys are shared.
    """
    kept, cells = ["rank", "sim_hi", "sim_lo"], [F.lit(0)]
    if min_jaccard is not None:
        kept, own = [*kept, "size"], F.floor(F.log("size") / F.lit(-math.log(min_jaccard - 1e-6)))
        cells = [own, own + 1]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), _part("sim_hi", hi), _part("sim_lo", lo), c).alias("key")) for i, (hi, lo) in enumerate(_masks(max_distance)) for c in cells])
    rows = nodes.select(*kept, F.explode(keys).alias("x")).select(*kept, "x.band", "x.key")
    return of_ranks(rows, staged(_shared(rows), "shared-keys"), "key")


def _shared(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")


def band_pairs(nodes: DataFrame, max_distance: int = 3, lead: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of ranks, a before b, that differ in at most max_distance bits; equal signatures are pairs too. With
    lead(rank), pairs of each of these nodes a with all others b.

    The join is on two bands at a time, where one on a narrow band would meet a fixed share of all signatures. A pair is
    taken under its first common bands only. Nodes are to be distinct sets, so that copies make no pairs.
    """
    return key_pairs(band_keys(nodes, max_distance), max_distance, lead)


def key_pairs(rows: DataFrame, max_distance: int = 3, lead: DataFrame | None = None) -> DataFrame:
    """band_pairs() of nodes given by their band_keys()."""
    a, b = (x.select(F.col("rank").alias(s), F.col("sim_hi").alias(f"{s}_hi"), F.col("sim_lo").alias(f"{s}_lo"), "band", "key") for x, s in ((rows if lead is None else rows.join(lead.hint("merge"), "rank", "left_semi"), "a"), (rows, "b")))
    order = F.col("a") < F.col("b") if lead is None else F.col("a") != F.col("b")
    near = a.join(b.hint("merge"), ["band", "key"]).filter(order & (hamming(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo")) <= max_distance))
    first = F.coalesce(*[F.when((_part("a_hi", hi) == _part("b_hi", hi)) & (_part("a_lo", lo) == _part("b_lo", lo)), i) for i, (hi, lo) in enumerate(_masks(max_distance))])
    return near.filter(first == F.col("band")).select("a", "b", "a_hi", "a_lo", "b_hi", "b_lo")


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b), sets(rank, hashes) -> a, b, jaccard (unrounded)."""
    j = pairs.select("a", "b").join(sets.select(F.col("rank").alias("a"), F.col("hashes").alias("sa")).hint("merge"), "a")
    j = j.join(sets.select(F.col("rank").alias("b"), F.col("hashes").alias("sb")).hint("merge"), "b")
    n = F.size(F.array_intersect("sa", "sb"))
    return j.select("a", "b", (n / (F.size("sa") + F.size("sb") - n)).alias("jaccard"))


#: Ranks up to which a selection of sets is broadcast (8 bytes each); beyond, sets are shuffled to them.
BROADCAST_RANKS = 1_000_000
#: Counts that sketch a set: its members by their first six bits.
CELLS = 64


@F.pandas_udf(ArrayType(LongType()))
def _unpacked(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in sets:
        for part in tx.pieces(batch):
            yield pd.Series([np.frombuffer(x, np.int64) for x in part])


@F.pandas_udf(ArrayType(ShortType()))
def _sketch(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in hashes:
        yield pd.Series([np.minimum(np.bincount(h.view(np.uint64) >> np.uint64(58), minlength=CELLS), 32767).astype(np.int16) for h in (np.asarray(x, np.int64) for x in batch)])


def of_ranks(sets: DataFrame, ranks: DataFrame, key: str = "rank") -> DataFrame:
    """Rows of sets whose key is in ranks(key), which has each once and is staged."""
    few = ranks.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS
    return sets.join(ranks.hint("broadcast" if few else "merge"), key, "left_semi")


def sketched(sets: DataFrame) -> DataFrame:
    """sets(rank, hashes), staged -> rank, size, sketch; staged."""
    return staged(sets.select("rank", F.size("hashes").alias("size"), _sketch("hashes").alias("sketch")), "near-sketches")


def matching(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, min_jaccard: float) -> DataFrame:
    """Of pairs(a, b) those whose sets(rank, hashes) are as similar as min_jaccard; exact.

    Sizes and sketches bound how many members two sets can share, so that whole sets are brought only to pairs which both allow.
    """
    j = pairs.select("a", "b").join(sketches.select(F.col("rank").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("ka")).hint("merge"), "a")
    j = j.join(sketches.select(F.col("rank").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("kb")).hint("merge"), "b")
    apart = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    # Each member that only one set has moves one count by one: the sets differ in `apart` members at least, so they share at most this.
    most = F.least(F.col("na"), F.col("nb"), (F.col("na") + F.col("nb") - apart) / 2)
    able = staged(j.filter(most >= (min_jaccard - 1e-9) * (F.col("na") + F.col("nb") - most)).select("a", "b"), "near-able")
    ranks = staged(able.select(F.col("a").alias("rank")).union(able.select("b")).distinct(), "near-able-ranks")
    return jaccard(able, of_ranks(sets, ranks)).filter(F.col("jaccard") >= min_jaccard).select("a", "b")


#: Pairs under shared keys that the walk meets at once: so many, and so many for each row of the keys.
PAIRS, PAIRS_A_ROW = 2_000_000, 20


class NearState(NamedTuple):
    """What a walk reads, staged: distinct sets (set_id, rank, row, sim_hi, sim_lo, size) by their first documents, the keys they share
    (band_keys) and, of those that share one, the sets (rank, hashes) and sketches. Where they make few pairs, these (key_pairs) and
    which of them match; sets and sketches are then of the nodes of pairs."""

    nodes: DataFrame
    keys: DataFrame
    sets: DataFrame
    sketches: DataFrame
    pairs: DataFrame | None
    edges: DataFrame | None


def _pairs_under(keys: DataFrame) -> tuple[int, bool]:
    """Rows of keys, and whether their nodes make few pairs."""
    found = keys.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    rows = found["rows"] or 0
    return rows, (found["pairs"] or 0) <= PAIRS + PAIRS_A_ROW * rows


def near_state(docs: DataFrame, sets: DataFrame, max_distance: int = 3, min_jaccard: float = 0.95) -> NearState:
    """docs(rank, row, able, sim_hi, sim_lo, size, set_id) and sets(row, hashes, as arrays or packed) -> the state of the able ones."""
    nodes = docs.filter("able").groupBy("set_id").agg(F.min(F.struct("rank", "row", "sim_hi", "sim_lo", "size")).alias("x"))
    nodes = staged(nodes.select("set_id", "x.*"), "near-nodes")
    keys = staged(band_keys(nodes, max_distance), "near-keys")
    pairs = staged(key_pairs(keys, max_distance).select("a", "b"), "near-pairs") if _pairs_under(keys)[1] else None
    met = keys.select("rank") if pairs is None else pairs.select(F.col("a").alias("rank")).union(pairs.select("b"))
    ids = staged(nodes.select("rank", "row").join(met.distinct().hint("merge"), "rank", "left_semi"), "near-ids")
    few = ids.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS
    sets = sets.join(ids.hint("broadcast" if few else "merge"), "row").select("rank", "hashes")
    sets = staged(sets if isinstance(sets.schema["hashes"].dataType, ArrayType) else sets.withColumn("hashes", _unpacked("hashes")), "near-sets")
    release(ids)
    sketches = sketched(sets)
    edges = None if pairs is None else staged(matching(pairs, sets, sketches, min_jaccard), "near-edges")
    return NearState(nodes, keys, sets, sketches, pairs, edges)


def kept_pairs(state: NearState, kept: DataFrame, max_distance: int = 3, min_jaccard: float = 0.95) -> DataFrame:
    """Pairs (a, b) within max_distance bits of nodes a in kept(rank) with all other nodes b, and whether they match, as `near`."""
    if state.pairs is None:
        pairs = staged(key_pairs(state.keys, max_distance, kept).select("a", "b"), "near-pairs")
        near = matching(pairs, state.sets, state.sketches, min_jaccard)
    else:
        both, near = (x.union(x.select(F.col("b"), F.col("a"))) for x in (state.pairs, state.edges))
        pairs = both.join(kept.select(F.col("rank").alias("a")).hint("merge"), "a", "left_semi")
    near = near.withColumn("_near", F.lit(True)).hint("merge")
    return pairs.join(near, ["a", "b"], "left").select("a", "b", F.col("_near").isNotNull().alias("near"))


def near_walk(state: NearState, max_distance: int = 3, min_jaccard: float = 0.95) -> DataFrame:
    """Ranks of the nodes that an earlier kept node matches.

    Where nodes under shared keys make few pairs, all are met at once, and the walk goes in rounds over those that match. Else it
    goes in rounds of leads first: an undecided node that is the first undecided under each of its keys (bands and size cell) is kept (all
    kept nodes before it have met it), meets the others under its keys, and those it matches go. So a group of near copies
    costs a comparison for each kept node and member, as in the walk, and never all its pairs. When such a round decides less than a
    tenth of the rows, the nodes are mostly kept ones, which the walk compares all; then they are met at once too.
    """
    keys, edges, spark = state.keys, state.edges, state.keys.sparkSession
    # Each round's ranks are a folder of one table, so that the plan of the result doesn't grow with the rounds.
    path, kind, turns = f"{shared_dir(spark)}/near-gone-{uuid.uuid4().hex}", keys.select("rank").schema, 0

    def written(ranks: DataFrame) -> DataFrame:
        nonlocal turns
        ranks.distinct().write.parquet(f"{path}/turn={turns}")
        turns += 1
        return spark.read.schema(kind).parquet(f"{path}/turn={turns - 1}")

    while edges is None:
        ranks = keys.select("rank").distinct()
        nodes = staged(state.nodes.select("rank", "sim_hi", "sim_lo", "size").join(ranks.hint("merge"), "rank", "left_semi"), "near-undecided")
        cells = staged(band_keys(nodes, max_distance, min_jaccard), "near-cells")
        lead = cells.groupBy("key").agg(F.min("rank").alias("lead"), F.min_by(F.struct("sim_hi", "sim_lo"), "rank").alias("w"))
        met = cells.join(lead.hint("merge"), "key")
        met = staged(met.select("rank", "lead", hamming(F.col("sim_hi"), F.col("sim_lo"), F.col("w.sim_hi"), F.col("w.sim_lo")).alias("distance")), "near-met")
        kept = met.groupBy("rank").agg(F.min(F.col("rank") == F.col("lead")).alias("first")).filter("first").select("rank")
        others = met.filter((F.col("rank") != F.col("lead")) & (F.col("distance") <= max_distance)).select(F.col("lead").alias("a"), F.col("rank").alias("b")).distinct()
        others = others.join(kept.select(F.col("rank").alias("a")).hint("merge"), "a", "left_semi")
        decided = kept.union(written(matching(others, state.sets, state.sketches, min_jaccard).select(F.col("b").alias("rank"))))
        # Nodes that share no key of a cell match nothing.
        left = keys.join(cells.select("rank").distinct().hint("merge"), "rank", "left_semi").join(decided.hint("merge"), "rank", "left_anti")
        left = staged(left.join(_shared(left).hint("merge"), "key", "left_semi"), "near-keys")
        rows, few = _pairs_under(left)
        if few or rows > 0.9 * keys.count():
            pairs = staged(key_pairs(left, max_distance).select("a", "b"), "near-pairs")
            edges = staged(matching(pairs, state.sets, state.sketches, min_jaccard), "near-edges")
            release(pairs)
        release(nodes, cells, met, *([] if keys is state.keys else [keys]))
        keys = left
    if keys is not state.keys:
        release(keys)
    while edges.limit(1).count():
        # Nodes that no undecided one comes before are kept, and what they match goes.
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).hint("merge"), "a", "left_anti")
        gone = written(edges.join(kept.hint("merge"), "a", "left_semi").select(F.col("b").alias("rank")))
        left = edges.join(gone.select(F.col("rank").alias("b")).hint("merge"), "b", "left_anti").join(gone.select(F.col("rank").alias("a")).hint("merge"), "a", "left_anti")
        before, edges = edges, staged(left.select("a", "b"), "near-edges")
        if before is not state.edges:
            release(before)
    if edges is not state.edges:
        release(edges)
    return spark.read.schema(kind).parquet(*[f"{path}/turn={i}" for i in range(turns)]) if turns else spark.createDataFrame([], kind)


def near_keep(docs: DataFrame, max_distance: int = 3, min_jaccard: float = 0.95, state: NearState | None = None) -> DataFrame:
    """docs(rank, able, sim_hi, sim_lo, hashes, set_id) -> rank, kept. Documents that aren't able stay; of equal sets only the first can.

    With near_state() of docs, made for the same bounds, they need no more than rank and able.
    """
    if state is None:
        row = docs.select("rank", F.col("rank").alias("row"), "able", "sim_hi", "sim_lo", F.size("hashes").alias("size"), "set_id")
        state = near_state(row, docs.select(F.col("rank").alias("row"), "hashes"), max_distance, min_jaccard)
    gone = near_walk(state, max_distance, min_jaccard)
    copies = docs.filter("able").select("rank").join(state.nodes.select("rank").hint("merge"), "rank", "left_anti")
    out = gone.union(copies).withColumn("_gone", F.lit(True))
    return docs.select("rank").join(out.hint("merge"), "rank", "left").select("rank", F.col("_gone").isNull().alias("kept"))


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, label): label is the smallest node reachable. Min-label propagation with label jumping."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = staged(step.join(jump.hint("merge"), "to", "left").select("node", "was", F.least("to", F.coalesce("far", "to")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter(F.col("was") != F.col("label")).limit(1).count():
            return labels
    raise RuntimeError("components not settled")
