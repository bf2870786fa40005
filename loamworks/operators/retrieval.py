"""Top-k retrieval over dense vectors and hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a block, on average: what a task holds at once is a batch of blocks, and k rows for each query it has met.
BLOCK = 1024
#: Queries of n-grams that tasks hold at once, at most about: 64 MB as a dense matrix of 8,192 dimensions.
NGRAM_QUERIES = 1000


def _blocks(df: DataFrame, out: str, parts: int | None = None) -> DataFrame:
    """Vectors packed into blocks of about BLOCK rows; each block is one row. They are dealt over `parts` partitions, for which small tables have smaller blocks, or one each."""
    rows = df.count()
    n = max(1, -(-rows // BLOCK), min(parts or 1, -(-rows // 128)))
    return df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(f"{out}_block")).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))).alias(out)).repartition(min(n, parts or n))


def _matrix(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and their lengths."""
    ids, v = block.field("id"), block.field("v")
    if ids.null_count or v.null_count or len(np.unique(np.diff(v.offsets))) > 1:
        raise ValueError("ids or embeddings are null, or embeddings differ in length")
    m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
    return ids.to_numpy().astype(np.int64), m, np.linalg.norm(m, axis=1)


def _better(kept: tuple, new: tuple, k: int) -> tuple:
    """The best k of each query (its place in the block), of (place, id, score); the smaller id is better among equals."""
    place, ids, scores = (np.concatenate(x) for x in zip(kept, new))
    order = np.lexsort((ids, -scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    few = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[few], ids[few], scores[few]


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """queries(vec_id, embedding), items(vec_id, embedding) -> query_id, vec_id, score, rank: all queries against all items.

    Blocks of queries meet blocks of items, each pair of blocks one matrix product. A task keeps the best k items a query over all its pairs;
    of a product only what reaches the k-th of them is rounded and ordered. Items are dealt over twice as many partitions as there are cores
    and queries over one a block at most, so what is shuffled grows with queries times cores, never with pairs. The products are all pairs.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _candidates(queries, items, k, exclude_self).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def _candidates(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, vec_id, score): each task's best k items a query."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            q, t = (batch.column(c) for c in ("q", "t"))
            for i, block in enumerate(batch.column("q_block").to_pylist()):
                (qid, a, na), (ids, b, nb) = _matrix(q[i].values), _matrix(t[i].values)
                s = (a @ b.T) / np.maximum(na[:, None] * nb[None], 1e-30)
                if exclude_self:
                    same = np.flatnonzero(np.isin(qid, ids))
                    s[same] = np.where(qid[same, None] == ids[None], -np.inf, s[same])
                _, mine, least = kept.get(block) or (qid, tuple(np.empty(0, x) for x in (np.int64, np.int64, float)), np.full(len(qid), -np.inf))
                if np.isneginf(least).any() and len(ids) > k:
                    least = np.fmax(least, np.partition(np.where(np.isnan(s), -np.inf, s), -k, axis=1)[:, -k])
                place, at = np.nonzero(s >= (least - 2e-6)[:, None])  # least may be rounded, s isn't
                score = s[place, at]
                real = np.isfinite(score)
                mine = _better(mine, (place[real], ids[at[real]], np.round(score[real], 6)), k)
                least = np.where(np.bincount(mine[0], minlength=len(qid)) < k, -np.inf, np.inf)
                np.minimum.at(least, mine[0], mine[2])
                kept[block] = qid, mine, least
        for qid, (place, ids, score), _ in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(qid[place]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    cores = items.sparkSession.sparkContext.defaultParallelism
    pairs = _blocks(items, "t", 2 * cores).hint("shuffle_replicate_nl").crossJoin(_blocks(queries, "q")).select("q_block", "q", "t")
    return pairs.mapInArrow(best, "query_id long, vec_id long, score double")


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def gram_vector(text: str, dims: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Unit vector of a text's character n-grams (between two spaces), each at the crc32 of its UTF-8 bytes modulo dims.

    The checksums of all n-grams of a size are made at once, byte by byte.
    """
    data = np.frombuffer(f" {text} ".encode(), np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.append(first[1:], len(data))
    v = np.zeros(dims)
    for n in sizes:
        start, end = first[: max(len(first) - n + 1, 0)], ends[n - 1 :]
        crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
        for k in range(int((end - start).max(initial=0))):
            on = np.flatnonzero(start + k < end)
            crc[on] = _CRC[(crc[on] ^ data[start[on] + k]) & 255] ^ (crc[on] >> 8)
        v += np.bincount(((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(dims)).astype(np.int64), minlength=dims)
    return v / max(np.linalg.norm(v), 1e-30)


def ngram_topk(queries: DataFrame, items: DataFrame, k: int, dims: int = 8192, sizes: tuple[int, ...] = (3, 4, 5), block: int = NGRAM_QUERIES) -> DataFrame:
    """queries(query_id, text), items(item_id, text) -> query_id, item_id, score, rank by cosine of hashed character n-grams.

    All queries against all items, in blocks of `block` queries: a block is a dense matrix (8 bytes a dimension) that goes to
    the tasks; an item becomes a vector where it is and is multiplied by the block. Only each task's best k items a query
    are shuffled. Null texts have no n-grams, and score nothing.
    """
    spark = items.sparkSession
    q = queries.select("query_id", F.lower(F.col("text").cast("string")).alias("text")).filter("text IS NOT NULL")
    parts = max(1, -(-2 * q.count() // block))  # about half a block each
    t = items.select("item_id", F.lower(F.col("text").cast("string")).alias("text")).filter("text IS NOT NULL")
    found = None
    for part in range(parts):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()  # bounded by the block
        if rows:
            shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([gram_vector(r.text, dims, sizes) for r in rows])))
            best = t.mapInPandas(_best(shared, k, dims, sizes), "query_id long, item_id long, score double")
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "query_id long, item_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def _best(shared, k: int, dims: int, sizes: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, matrix = shared.value
        kept = pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                ids = part["item_id"].to_numpy()
                s = np.round(matrix @ np.array([gram_vector(x, dims, sizes) for x in part["text"]]).T, 6)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                row = np.repeat(np.arange(len(qid)), order.shape[1])
                new = pd.DataFrame({"query_id": qid[row], "item_id": ids[order.reshape(-1)], "score": s[row, order.reshape(-1)]})
                kept = pd.concat([kept, new[new["score"] > 0]]) if len(kept) else new[new["score"] > 0]
                kept = kept.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        yield kept.astype({"query_id": "int64", "item_id": "int64", "score": "float64"})

    return run
