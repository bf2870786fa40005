"""Top items by cosine: equal to a plain form with ties, equal ids and zero vectors, and few rows leave a task."""

import numpy as np
import pytest

from loamworks.operators import retrieval


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("block", [1024, 40])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_equal_to_a_plain_form(spark, monkeypatch, block, exclude_self):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rnd = np.random.default_rng(3)
    v = np.concatenate([rnd.integers(-1, 2, (300, 4)), rnd.normal(size=(100, 4)), np.repeat(rnd.normal(size=(1, 4)), 60, 0)]).astype(np.float32).astype(float)
    ids = np.append(rnd.permutation(450), [7] * 10)
    s = np.round(v @ v.T / np.maximum(np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1), 1e-30), 6)
    first = {int(i): n for n, i in reversed(list(enumerate(ids)))}
    asked = [i for i in first if i % 9 == 0]
    want = {}
    for i in asked:
        found = sorted((-s[first[i], n], int(j)) for n, j in enumerate(ids) if not exclude_self or j != i)[:7]
        want[i] = [(j, -x) for x, j in found]
    e = frame(spark, ids, v)
    got = {}
    for r in retrieval.cosine_topk(frame(spark, asked, v[[first[i] for i in asked]]), e, 7, exclude_self).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    assert retrieval.cosine_topk(e.limit(0), e, 7).count() == retrieval.cosine_topk(e, e.limit(0), 7).count() == 0


def test_rows_of_a_task_do_not_grow_with_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    v = np.random.default_rng(1).normal(size=(2000, 4))
    e = frame(spark, range(2000), v)
    found = retrieval._candidates(e.filter("vec_id < 10"), e, 3, True)
    assert 30 <= found.count() <= 3 * 10 * 2 * spark.sparkContext.defaultParallelism  # 7,500, k a pair of blocks, before


def test_null_embeddings_fail(spark):
    e = frame(spark, range(3), [[1, 0], None, [0, 1]])
    with pytest.raises(Exception, match="null"):
        retrieval.cosine_topk(e, e, 1).collect()
