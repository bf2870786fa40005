from itertools import product

import numpy as np

from loamworks.llm import quality_crf as crf

from . import cases


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for s in np.unique(score):
        at = np.flatnonzero(score == s)
        rank[at] = np.searchsorted(score[order], s, "left") + (len(at) + 1) / 2
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([3, 1, 5, 2])
    s, trans = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    p, pair, logz = crf.marginals(s, lines, trans)
    at, want_p, want_pair, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in lines:
        ways = list(product((0, 1), repeat=n))
        w = np.exp([sum(s[at + i, y[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])) for y in ways])
        want_z += np.log(w.sum())
        want_p += [sum(x for x, y in zip(w, ways) if y[i]) / w.sum() for i in range(n)]
        for x, y in zip(w / w.sum(), ways):
            for a, b in zip(y, y[1:]):
                want_pair[a, b] += x
        at += n
    assert np.allclose(p, want_p) and np.allclose(pair, want_pair) and np.isclose(logz, want_z)


def test_held_out_quality(spark):
    docs, labels = cases.documents(spark, "sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = crf.train(docs, labels)
    got = {r.doc_id: r.score for r in crf.score(docs, model).collect()}
    assert len(got) == 10_000 and all(0 <= x <= 1 for x in got.values())
    test = [(got[r.doc_id], r.quality) for r in labels.collect() if crf.held_out(r.doc_id)]
    s, y = np.array([a for a, _ in test]), np.array([b for _, b in test])
    print("AUC", auc(s, y), "accuracy", ((s >= 0.5) == y).mean(), "base", max(y.mean(), 1 - y.mean()))
    assert auc(s, y) > 0.9


def test_awkward(spark):
    docs = spark.createDataFrame(cases.awkward(), cases.DOCS)
    labels = spark.createDataFrame([(20, 1), (21, 1), (22, 0), (1, None), (None, 1), (10, 1), (10, 1), (23, 0)], "doc_id long, quality int")
    got = crf.score(docs, crf.train(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in cases.awkward()) and all(0 <= r.score <= 1 for r in got)
    assert {round(r.score, 9) for r in crf.score(docs, crf.train(docs, labels.limit(0))).collect()} == {0.5}
    assert crf.score(docs.limit(0), crf.Model()).count() == 0
