"""Code lengths against a plain recursion over dictionaries; held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loamworks.llm import language_id as li

from . import cases


def plain_counts(texts):
    seen = defaultdict(Counter)
    for t in texts:
        x = li.PAD + t
        for i in range(li.ORDER, len(x)):
            for k in range(li.ORDER + 1):
                seen[x[i - k : i]][x[i]] += 1
    return {c: n for c, n in seen.items() if len(c) <= 2 or sum(n.values()) >= li.MIN_SEEN}


def plain_probability(seen, context, byte, without=frozenset()):
    if context in seen:
        n = {s: c for s, c in seen[context].items() if s not in without}
        total = sum(n.values()) + len(n)
        if byte in n:
            return n[byte] / total
        escape = len(n) / total if total else 1.0
        without = without | set(seen[context])
    else:
        escape = 1.0
    if not context:
        return escape / (256 - len(without))
    return escape * plain_probability(seen, context[1:], byte, without)


TEXTS = [b"the cat sat on the mat and the rat sat", "é à la carte, ça va là".encode(), b"aaaaab" * 9, b"x"]


def test_code_lengths_equal_the_plain_recursion():
    tree, seen, rnd = li.Tree.fit(TEXTS), plain_counts(TEXTS), random.Random(3)
    tree = li.Tree.load(tree.save())
    tests = TEXTS + [bytes(rnd.choice(b"the cats \xc3\xa9z") for _ in range(40)) for _ in range(30)] + [b"q", b"\xff\xff"]
    for t in tests:
        x = li.PAD + t
        want = [-math.log2(plain_probability(seen, x[i - li.ORDER : i], x[i])) for i in range(li.ORDER, len(x))]
        assert np.allclose(tree.code_lengths(li.windows([t])[1]), want)


def test_probabilities_behind_a_context_sum_to_one():
    tree = li.Tree.fit(TEXTS)
    for context in (b"e cat", b" sat ", b"zzzzz", b"aaaaa", b"\xff\xff\xff\xff\xff", b"zz th"):
        w = sum(np.uint64(b) << np.uint64(8 * (i + 1)) for i, b in enumerate(context)) + np.arange(256, dtype=np.uint64)
        assert np.exp2(-tree.code_lengths(w)).sum() == pytest.approx(1)


def test_kept_windows_change_nothing(monkeypatch):
    trees = {"a": li.Tree.fit(TEXTS[:1]), "b": li.Tree.fit(TEXTS[1:])}
    m = li.Models(trees)
    first = m.code_lengths(TEXTS)
    assert np.array_equal(m.code_lengths(TEXTS), first)
    monkeypatch.setattr(li, "CACHE", 0)
    assert np.array_equal(li.Models(trees).code_lengths(TEXTS), first)
    assert [li.Models(trees).predict([t])[0][0] for t in TEXTS] == ["a", "b", "b", "b"]


def test_held_out_accuracy_and_fold(spark):
    docs = cases.documents(spark, "sf0.01")
    rows = {r.doc_id: r for r in li.op12_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: (r.lang, len(cases.words(r.text))) for r in docs.collect()}
    assert rows.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [(r.lang_pred == truth[d][0]) for d, r in rows.items() if r.held_out and truth[d][1] >= 10]
    assert len(held) > 200 and sum(held) / len(held) > 0.99


def test_only_the_learning_fold_counts(spark):
    docs = cases.documents(spark, "sf0.001")
    held = li._fold(docs.doc_id) == li.HELD_OUT
    wrong = docs.withColumn("lang", li.F.when(held, li.F.lit("xx")).otherwise(docs.lang))
    assert li.train(wrong) == li.train(docs)


def test_awkward(spark):
    a, b, c, d, e, f, g, h = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    data = [(a, "der die das und ist nicht", "de"), (b, "the of and to in is", "en"), (c, None, "en"), (d, "", "de"), (e, "12 34 ---", None), (f, "the of and", None), (None, "der die das", "fr"), (g, "x" * 200_000, "en"), (b, "the of and to in is", "en"), (h, "\x00 der", "de")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 AS letters", "'k' AS o")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in li.predict(docs, li.train(docs)).collect()), key=str)
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == len(data) and by[c] == by[d] == by[e] == ("und", 0.0) and by[f][0] == "en" and by[None][0] == "de"
    assert all(0 <= s <= 1 for _, _, s in got)
    assert li.train(docs.limit(0)) == {} and li.predict(docs.limit(0), li.train(docs)).count() == 0
    assert {r.lang_pred for r in li.predict(docs, {}).collect()} == {"und"}
