"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are its own and those of its neighbours (shape only: lengths, character classes, repetition). The chain's
forward-backward marginals give each line's probability of being good, and a document's quality is their mean, weighted by
the lines' lengths in words. A document without a word is one empty line.

The model is fitted on labelled documents, each line bearing its document's label: on at most TRAIN_DOCS of them, the
first in a seeded order, of at most TRAIN_LINES lines each. That bound keeps fitting on one machine whatever the corpus (what
reaches the driver is 4 bytes for each of OWN features a line: 86 MB if all lines are there, 7 MB as measured); scoring covers
all documents and lines. doc_id decides only which documents may train; doc_id, lang, source and labels
are no features.

Nulls: a null text is empty; labels that are null don't train. Without any usable label every score is 0.5. Very long texts
are scored whole. Repeated rows are scored each; of rows with one id a single text trains, and of an id's labels the larger.
Ties get equal scores. Empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordhash import Texts, chunks

TRAIN_DOCS = 4000
TRAIN_LINES = 300
FOLDS, HELD_OUT = 3, 1
SEED = 9
EPOCHS, RATE, DECAY = 40, 0.05, 1e-4
OWN = 18
FEATURES = 3 * OWN + 3

_CLASSES = np.zeros((256, 6), np.float64)
_CLASSES[list(b"#*$%&<>@^~=+{}[]\\"), 0] = 1
_CLASSES[list(b"|"), 1] = 1
_CLASSES[65:91, 2] = 1
_CLASSES[97:123, 3] = 1
_CLASSES[48:58, 4] = 1
_CLASSES[list(b"!"), 5] = 1


def _first_of(sorted_doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether an (doc, hash) pair was not there before."""
    order = np.lexsort((np.arange(len(h)), h, sorted_doc))
    new = np.ones(len(h), bool)
    new[order[1:]] = (h[order][1:] != h[order][:-1]) | (sorted_doc[order][1:] != sorted_doc[order][:-1])
    return new


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, weights, features) of all lines with a word; a text without one has one empty line."""
    x = Texts(texts, fold=False)
    doc, no, words, raw, _ = x.lines()
    n = len(doc)
    own = np.zeros((n, OWN))
    if n:
        at = np.cumsum(words) - words
        first, last = x.start[at], x.end[at + words - 1]
        cls = np.concatenate([np.zeros((1, 6)), np.cumsum(_CLASSES[x.data], axis=0)])
        sums = cls[last] - cls[first]
        size = (last - first).astype(float)
        length = (x.end - x.start).astype(float)
        total = lambda v: np.add.reduceat(v.astype(float), at)
        letters = np.maximum(sums[:, 2] + sums[:, 3], 1)
        line_of = np.repeat(np.arange(n), words)
        fresh = _first_of(line_of, x.word)
        again = np.zeros(len(x.word), bool)
        again[1:] = (x.word[1:] == x.word[:-1]) & (line_of[1:] == line_of[:-1])
        seen = ~_first_of(x.doc, x.word)
        w_at, w_hash = x.windows(3)
        cover = np.zeros(len(x.word) + 3, bool)
        twice = ~_first_of(x.doc[w_at], w_hash)
        for k in range(3):
            cover[w_at[twice] + k] = True
        tail = x.data[x.end - 1]
        stop = np.isin(tail, np.frombuffer(b".,;:!?", np.uint8))
        caps = (x.data[x.start] >= 65) & (x.data[x.start] < 91)
        odd = np.isin(tail, np.frombuffer(b"#*$%&|<>", np.uint8))
        own = np.stack(
            [
                np.ones(n), np.log1p(words) / 5, np.minimum(total(length) / words, 20) / 10, sums[:, 0] / size * 5, sums[:, 1] / words, sums[:, 2] / letters,
                sums[:, 4] / size * 5, sums[:, 5] / words, total(fresh) / words, total(again) / words, total(seen) / words, total(cover[: len(x.word)]) / words,
                (~_first_of(doc, raw)).astype(float), np.isin(x.data[last - 1], np.frombuffer(b".?", np.uint8)).astype(float), total(stop) / words, total(caps) / words, total(odd) / words, total(length <= 3) / words,
            ],
            axis=1,
        )
    lines = np.bincount(doc, minlength=x.n) if n else np.zeros(x.n, np.int64)
    empty = np.flatnonzero(lines == 0)
    if len(empty):
        doc = np.concatenate([doc, empty])
        own = np.concatenate([own, np.zeros((len(empty), OWN))])
        words = np.concatenate([words, np.ones(len(empty), np.int64)])
        order = np.argsort(doc, kind="stable")
        doc, own, words = doc[order], own[order], words[order]
        lines[empty] = 1
    return lines, words.astype(float), with_neighbours(doc, own)


def with_neighbours(doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A line's own features, those of the lines before and behind it in its document, and marks of the document's ends."""
    n = len(doc)
    out = np.zeros((n, FEATURES), own.dtype)
    out[:, :OWN] = own
    same = doc[1:] == doc[:-1]
    out[1:][same, OWN : 2 * OWN] = own[:-1][same]
    out[:-1][same, 2 * OWN : 3 * OWN] = own[1:][same]
    out[:, -3] = 1
    out[1:, -2] = ~same
    out[:1, -2] = 1
    out[:-1, -1] = ~same
    out[-1:, -1] = 1
    return out


def _by_length(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling number of lines, where each starts, and how many have a t-th line."""
    order = np.argsort(-lines, kind="stable")
    start = (np.cumsum(lines) - lines)[order]
    active = np.searchsorted(-lines[order], -np.arange(lines.max(initial=0)), side="left")
    return order, start, active


def _log_sum(v: np.ndarray) -> np.ndarray:
    m = v.max(axis=1)
    return m + np.log(np.exp(v - m[:, None, :] if v.ndim == 3 else v - m[:, None]).sum(axis=1))


def marginals(scores: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transitions, sum of log partition functions); scores[line, label]."""
    order, start, active = _by_length(lines)
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    if not len(scores):
        return np.empty(0), np.zeros((2, 2)), 0.0
    alpha[start] = scores[start]
    for t in range(1, len(active)):
        at = start[: active[t]] + t
        alpha[at] = scores[at] + _log_sum(alpha[at - 1][:, :, None] + trans[None])
    for t in range(len(active) - 2, -1, -1):
        at = start[: active[t + 1]] + t
        beta[at] = _log_sum((beta[at + 1] + scores[at + 1])[:, :, None] + trans.T[None])
    ends = start + lines[order] - 1
    z = np.zeros(len(lines))
    z[order] = _log_sum(alpha[ends])
    zl = np.repeat(z, lines)
    p = np.exp(alpha + beta - zl[:, None])
    inner = np.ones(len(scores), bool)
    inner[ends] = False
    a = np.flatnonzero(inner)
    pair = np.exp(alpha[a][:, :, None] + trans[None] + (beta[a + 1] + scores[a + 1])[:, None, :] - zl[a][:, None, None]).sum(0) if len(a) else np.zeros((2, 2))
    return p[:, 1], pair, float(z.sum())


class Model:
    """Weights of a line's score for label 1 (label 0 scores 0), and of transitions."""

    def __init__(self, weights: np.ndarray | None = None, trans: np.ndarray | None = None) -> None:
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.trans = np.zeros((2, 2)) if trans is None else trans

    def lines(self, lines: np.ndarray, features: np.ndarray) -> np.ndarray:
        s = np.stack([np.zeros(len(features)), features @ self.weights], axis=1)
        return marginals(s, lines, self.trans)[0]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        lines, words, features = line_features(texts)
        p = self.lines(lines, features)
        at = np.cumsum(lines) - lines
        return np.clip(np.add.reduceat(p * words, at) / np.add.reduceat(words, at), 0.0, 1.0) if len(texts) else np.empty(0)


def fit(lines: np.ndarray, features: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Maximum likelihood with Adam over batches of documents; lines bear their documents' labels."""
    model = Model()
    if not len(lines):
        return model
    rng = np.random.default_rng(seed)
    at = np.cumsum(lines) - lines
    theta, m, v, step = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), 0
    size = 256
    for epoch in range(epochs):
        perm = rng.permutation(len(lines))
        for b in range(0, len(perm), size):
            of = perm[b : b + size]
            n = lines[of]
            idx = np.repeat(at[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            f, y = features[idx].astype(float), np.repeat(labels[of], n).astype(float)
            trans = theta[FEATURES:].reshape(2, 2)
            p, pair, _ = marginals(np.stack([np.zeros(len(f)), f @ theta[:FEATURES]], axis=1), n, trans)
            true = np.zeros((2, 2))
            np.add.at(true, (labels[of], labels[of]), n - 1)
            grad = np.concatenate([f.T @ (y - p), (true - pair).reshape(-1)]) / n.sum() - DECAY * theta
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + RATE * (0.5 ** (epoch / 15)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in chunks(batch.column("text")):
            lines, _, f = line_features(texts)
            off = np.append(0, np.cumsum(lines))
            some = np.flatnonzero(lines <= TRAIN_LINES)
            take = pa.array(some)
            data = [f[off[i] : off[i + 1], :OWN].astype(np.float32).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([batch.column("o").slice(a, b - a).take(take), batch.column("quality").slice(a, b - a).take(take), pa.array(lines[some].astype(np.int32)), pa.array(data, pa.binary())], ["o", "quality", "lines", "data"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, seed: int = SEED) -> Model:
    """Fit on at most `limit` labelled documents outside the held-out fold, the first by a seeded hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(common.seeded_key(seed, F.col("doc_id")), "doc_id").limit(limit)
    # One text an id (the first by its hash), so that repeated ids don't exceed the bound: `limit` documents of TRAIN_LINES lines.
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most `limit` rows
    picked = picked.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = picked.select("quality", "text", common.seeded_key(seed, F.col("doc_id")).alias("o")).mapInArrow(_featurise, "o long, quality int, lines int, data binary").orderBy("o", "data").collect()
    if not rows:
        return Model()
    lines = np.array([r.lines for r in rows], np.int64)
    own = np.concatenate([np.frombuffer(r.data, np.float32).reshape(-1, OWN) for r in rows])
    return fit(lines, with_neighbours(np.repeat(np.arange(len(lines)), lines), own), np.array([r.quality for r in rows], np.int64), seed=seed)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for batch in batches:
            for a, b, texts in chunks(batch.column("text")):
                part = batch.column("doc_id").slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part, pa.array(m.documents(texts))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), f"doc_id {kind}, score double")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_quality_crf": op9_quality_crf}
ORACLES = {}
