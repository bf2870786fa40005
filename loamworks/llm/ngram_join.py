"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct five-word shingles (64-bit hashes; words folded A-Z). Equal sets are one node, so
exact copies are never paired. All shingles are put in one global order, rare first by a fixed-size frequency sketch of
all documents, and a node's prefix is its first  n - ceil(0.8 n) + 1  shingles: nodes that link share a prefix shingle.

Pairs are compared in two steps, and each pair at most once:
1. Under every shared prefix shingle each node meets the node that has the shingle earliest (the pivot), so a group of
   near copies costs one comparison a node, not one a pair. Of its pivots a node is verified with the one with which it
   shares most prefix shingles. Verified links give components.
2. Under shingles whose nodes still lie in more than one component, the nodes of different components are paired. A shingle's
   nodes are split into bands of sizes (each 1 / 0.8 of the one before); a node meets larger ones of its own and the next
   band, and only under the first ninth of its own shingles, in which a pair's first shared shingle must lie. Nothing is left
   out: pairs inside a component need no comparison, as they can't change it.
Length (sizes within 0.8), positional (overlap still possible behind the shared shingle) and suffix filters (Hamming bound
from how many shingles lie in each of 256 hash ranges) discard pairs before both sets are brought together and intersected.

Nulls: a null or wordless text has an empty set and links with nothing; a null doc_id takes part and is never the
smallest id. Very long texts are shingled whole. Repeated rows and ties get the same result each. Empty table: an empty
result. Extra columns are ignored, and kept by deduplicate(), whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected
from .wordhash import Texts, U, chunks, mix, per_doc, ragged

SHINGLE = 5
#: Counters of the frequency sketch and of the bitmaps: fixed sizes (8 MB each), whatever the input.
SKETCH, BLOCKS = 1 << 20, 64
KEY_BITS, NODE_BITS = 1 << 26, 1 << 23
RANGES = 256
NUM, DEN = 8, 10  # similarity of at least NUM / DEN


def _signature(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    off = per_doc(doc, n)
    size = np.diff(off)
    full = size > 0
    s1, s2 = np.zeros(n, U), np.zeros(n, U)
    if len(h):
        s1[full] = mix(np.add.reduceat(mix(h ^ U(0x5BF0363546274B21)), off[:-1][full]) + size[full].astype(U))
        s2[full] = mix(np.add.reduceat(mix(h ^ U(0x1F83D9ABFB41BD6B)), off[:-1][full]))
    return off, size, s1.view(np.int64), s2.view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, th, n, s1, s2), and at the end of the task its frequency sketch in blocks."""
    counts = np.zeros(SKETCH, np.int64)
    names = ["doc_id", "th", "n", "s1", "s2", "part", "block", "counts"]
    for batch in batches:
        for a, b, texts in chunks(batch.column("text")):
            doc, h = Texts(texts, fold=True).shingles(SHINGLE)
            counts += np.bincount((h & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            _, size, s1, s2 = _signature(doc, h, b - a)
            none = pa.nulls(b - a, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2), none, none, pa.nulls(b - a, pa.binary())], names)
    if counts.any():
        part = TaskContext.get().partitionId()
        blocks = [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in counts.reshape(BLOCKS, -1)]
        none = pa.nulls(BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array([part] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names)


_SCAN = "doc_id long, th long, n long, s1 long, s2 long, part int, block int, counts binary"


def _add_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH // BLOCKS, np.int64)
    for x in rows["counts"]:
        total += np.frombuffer(zlib.decompress(x), np.int64)
    return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // 256], "block": [int(rows["block"].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})


def _sketch(blocks: DataFrame) -> np.ndarray:
    """The summed sketch. Tasks' blocks are added 256 at a time, so that no group is large; what comes back is 8 MB."""
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    blocks = blocks.select("part", "block", "counts")
    while True:
        blocks = blocks.groupBy("block", F.floor(F.col("part") / 256).alias("_p")).applyInPandas(_add_blocks, "part int, block int, counts binary")
        parts = (parts + 255) // 256
        if parts == 1:
            break
    total = np.zeros((BLOCKS, SKETCH // BLOCKS), np.int64)
    for r in blocks.collect():
        total[r.block] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return total.reshape(-1)


def _prefixes(sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                doc, h = Texts(texts, fold=True).shingles(SHINGLE)
                off, size, s1, s2 = _signature(doc, h, b - a)
                profile = np.zeros((b - a, RANGES), np.int64)
                np.add.at(profile, (doc, (h >> U(56)).astype(np.int64)), 1)
                order = np.lexsort((h, sketch.value[(h & U(SKETCH - 1)).astype(np.int64)], doc))
                keep = size - (NUM * size + DEN - 1) // DEN + (size > 0)
                keys = h[order][(np.arange(len(h)) - np.repeat(off[:-1], size)) < np.repeat(keep, size)]
                some = np.flatnonzero(size)
                ends = np.concatenate([[0], np.cumsum(keep[some])])
                cols = [batch.column(c).slice(a, b - a).take(pa.array(some)) for c in ("doc_id", "th")] + [pa.array(size[some].astype(np.int64)), pa.array(s1[some]), pa.array(s2[some]), ragged(keys.view(np.int64), ends, pa.int64())]
                cols.append(pa.array([x.astype(np.uint16).tobytes() if x.max() < 65536 else b"" for x in profile[some]], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "s1", "s2", "prefix", "profile"])

    return run


def _bitmap(df: DataFrame, value, bits: int) -> np.ndarray:
    """Bitmap of pmod(value, bits) over df: bits / 8 bytes, a bound that doesn't depend on the input."""
    b = F.pmod(value, F.lit(bits)) + 1
    rows = df.select(b.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.m, np.uint8)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bits of signed 64-bit values are set; pmod by a power of two is a mask."""
    at = h & np.int64(bits - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _postings(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("prefix")
                keys = lists.flatten().to_numpy(zero_copy_only=False)
                size = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
                on = _has(bitmap.value, keys, KEY_BITS)
                row = row[on]
                take = lambda c: pa.array(part.column(c).to_numpy()[row])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(keys[on]), take("node"), pa.array(pos[on].astype(np.int64)), take("n")], ["key", "node", "pos", "n"])

    return run


def _possible(na, nb, pa_, pb) -> F.Column:
    """Length and positional filters for a shared prefix shingle at positions pa_ and pb (from 0)."""
    small, large = F.least(na, nb), F.greatest(na, nb)
    overlap = F.least(na - pa_, nb - pb)
    return (DEN * small >= NUM * large) & ((NUM + DEN) * overlap >= NUM * (na + nb))


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose Hamming bound allows the overlap: sum of |count differences| over hash ranges <= |a| + |b| - 2 overlap."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            left, right = (part.column(c).to_pylist() for c in ("pa", "pb"))
            na, nb = (part.column(c).to_numpy() for c in ("na", "nb"))
            ok = np.ones(part.num_rows, bool)
            full = np.array([bool(x and y) for x, y in zip(left, right)], bool)
            if full.any():
                of = np.flatnonzero(full)
                x, y = (np.frombuffer(b"".join(p[i] for i in of), np.uint16).reshape(len(of), RANGES).astype(np.int32) for p in (left, right))
                need = -(-NUM * (na + nb) // (NUM + DEN))
                ok[of] = np.abs(x - y).sum(1) <= (na + nb - 2 * need)[of]
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep)], ["a", "b"])


def _sets_of(bitmap):
    """Sets of the texts whose hash is in the bitmap: one text of each node in question, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(_has(bitmap.value, batch.column("th").to_numpy(), NODE_BITS))))
            for a, b, texts in chunks(batch.column("text")):
                doc, h = Texts(texts, fold=True).shingles(SHINGLE)
                off, size, s1, s2 = _signature(doc, h, b - a)
                of = np.flatnonzero(size > 0)
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(size[of].astype(np.int64)), pa.array(s1[of]), pa.array(s2[of]), pa.array([h[off[i] : off[i + 1]].tobytes() for i in of], pa.binary())], ["n", "s1", "s2", "hashes"])

    return run


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "ha", "hb"))
        on = []
        for i in range(batch.num_rows):
            u, v = np.frombuffer(x[i], U), np.frombuffer(y[i], U)
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            at[at == len(v)] = 0
            same = int((v[at] == u).sum())
            if (NUM + DEN) * same >= NUM * (len(u) + len(v)):
                on.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in on], pa.int64()), pa.array([b[i] for i in on], pa.int64())], ["a", "b"])


class _Corpus:
    """What the two steps share: documents, nodes, and how to verify pairs of nodes."""

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        self.spark = spark
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = docs.withColumn("th", F.xxhash64("text"))
        scanned = common.materialise(self.docs.mapInArrow(_scan, _SCAN), "ngram-scan")
        self.rows = scanned.filter("block IS NULL").select("doc_id", "th", "n", "s1", "s2")
        sketch = spark.sparkContext.broadcast(_sketch(scanned.filter("block IS NOT NULL")))
        found = self.docs.mapInArrow(_prefixes(sketch), "doc_id long, th long, n long, s1 long, s2 long, prefix array<long>, profile binary")
        found = found.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("min_doc"), F.min("th").alias("th"), F.first("prefix").alias("prefix"), F.first("profile").alias("profile"))
        self.nodes = common.materialise(found.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")

    def postings(self) -> DataFrame:
        """(key, node, pos, n) of the prefix shingles that two nodes share (and few others)."""
        shared = self.nodes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
        bits = self.spark.sparkContext.broadcast(_bitmap(shared, F.col("key"), KEY_BITS))
        return common.materialise(self.nodes.select("node", "n", "prefix").mapInArrow(_postings(bits), "key long, node long, pos long, n long"), "ngram-postings")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links among distinct pairs(a, b)."""
        profile = self.nodes.select("node", "n", "profile")
        side = lambda s: profile.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("profile").alias(f"p{s}")).hint("merge")
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_suffix_filter, "a long, b long")
        near = common.materialise(near, "ngram-near")
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = self.nodes.select("node", "n", "s1", "s2", "th").join(ends.hint("merge"), "node", "left_semi")
        ids = common.materialise(ids, "ngram-ends")
        bits = self.spark.sparkContext.broadcast(_bitmap(ids, F.col("th"), NODE_BITS))
        sets = self.docs.select("th", "text").mapInArrow(_sets_of(bits), "n long, s1 long, s2 long, hashes binary")
        sets = sets.groupBy("n", "s1", "s2").agg(F.first("hashes").alias("hashes")).join(ids.drop("th").hint("merge"), ["n", "s1", "s2"]).select("node", "hashes")
        sets = common.materialise(sets, "ngram-sets")
        one = near.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")).hint("merge"), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")).hint("merge"), "b")
        links = common.materialise(two.mapInArrow(_intersect, "a long, b long"), "ngram-links")
        common.release(sets, ids, near)
        return links


def _between_components(open_: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components that share a key and may link."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    side = lambda s, *more: [F.col(x).alias(f"{x}_{s}") for x in ("node", "pos", "n", "comp")] + list(more)
    # The smaller of a pair has its first shared shingle among the first n - overlap + 1, with an overlap of 2 * 0.8 / 1.8 of n at least.
    small = open_.filter(F.col("pos") <= F.col("n") - F.ceil(2 * NUM * F.col("n") / (NUM + DEN) - 1e-9))
    small = small.select("key", *side("a", F.explode(F.array(size, size + 1)).alias("band")))
    large = open_.select("key", *side("b", size.alias("band")))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    pairs = small.hint("merge").join(large.hint("merge"), ["key", "band"]).filter(smaller & (F.col("comp_a") != F.col("comp_b")) & _possible(F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b")))
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with n, s1, s2; nodes with their component)."""
    c = _Corpus(docs)
    posts = c.postings()
    order = F.shiftleft(F.col("pos"), 40).bitwiseOR(F.shiftrightunsigned(F.xxhash64("node"), 24))
    pivots = posts.groupBy("key").agg(F.min_by("node", order).alias("pivot"), F.min_by("n", order).alias("pn"), F.min("pos").alias("ppos"), F.count("*").alias("c")).filter("c > 1").drop("c")
    met = posts.join(pivots.hint("merge"), "key").filter((F.col("node") != F.col("pivot")) & _possible(F.col("n"), F.col("pn"), F.col("pos"), F.col("ppos")))
    met = met.groupBy("node", "pivot").agg(F.count("*").alias("shared"))
    best = met.groupBy("node").agg(F.max_by("pivot", F.shiftleft(F.col("shared"), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64("pivot"), 33))).alias("pivot"))
    first = common.materialise(best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "ngram-first")
    links = c.verify(first)
    comps = connected(links)
    labelled = posts.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("key", "node", "pos", "n", "comp")
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = common.materialise(labelled.join(open_keys.hint("merge"), "key", "left_semi"), "ngram-open")
    cross = _between_components(open_).join(first.hint("merge"), ["a", "b"], "left_anti")
    cross = common.materialise(cross, "ngram-cross")
    more = c.verify(cross)
    common.release(posts, open_, first, cross)
    if more.limit(1).count():
        comps = connected(links.unionByName(more))
    nodes = c.nodes.select("node", "n", "s1", "s2", "min_doc").join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = nodes.groupBy("comp").agg(F.min("min_doc").alias("component_id"))
    return c.rows, nodes.join(least.hint("merge"), "comp").select("n", "s1", "s2", "comp", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, th (xxhash64 of the text), n_shingles, comp (label; null for empty sets), component_id."""
    rows, nodes = _components(docs)
    j = rows.join(nodes.hint("merge"), ["n", "s1", "s2"], "left")
    return j.select("doc_id", "th", F.col("n").alias("n_shingles"), "comp", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the smallest doc_id (then text hash). Rows alike in doc_id and text are one."""
    d, t, th = common.fresh(docs, "d", "t", "th")
    found = common.materialise(components(docs), "ngram-components")
    alone = found.filter("comp IS NULL").select("doc_id", "th")
    best = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "th", "doc_id")).alias("w")).select("w.doc_id", "w.th")
    stay = alone.unionByName(best).distinct().select(F.col("doc_id").alias(d), F.col("th").alias(t))
    keyed = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    if found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", th])  # another shuffle of the texts, for tables with repeated rows only
    return keyed.join(stay.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), "left_semi").select(*docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs of sets that share a shingle; for small tables.
SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])] AS w FROM documents),
s AS (SELECT DISTINCT r, unnest([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, greatest(len(w) - 4, 1))]) AS s FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS set_id FROM s GROUP BY r),
v AS (SELECT set_id, any_value(n) AS n, min(r) AS r, min(doc_id) AS least FROM n JOIN d USING (r) GROUP BY set_id),
x AS (SELECT v.r, n, s FROM v JOIN s USING (r)),
e AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, label) USING KEY (node) AS (SELECT r, r FROM v UNION SELECT u.node, min(o.label) FROM recurring.cc u JOIN both_ways w ON w.a = u.node JOIN cc o ON o.node = w.b WHERE o.label < u.label GROUP BY u.node),
k AS (SELECT label, min(least) AS component_id FROM cc JOIN v ON v.r = cc.node GROUP BY label)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE component_id END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN v USING (set_id) LEFT JOIN cc ON cc.node = v.r LEFT JOIN k USING (label)"""
QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLES = {"op4_ngram_join": SQL}
