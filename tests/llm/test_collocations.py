"""Collocations against plain counting, with ranked and hashed units, dense and sparse tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loamworks.llm import collocations as co

from . import cases


def plain(rows, min_count, max_words, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        over = Counter()
        for q, b in c.items():
            for k in range(2, len(q)) if b >= min_count else ():
                for i in range(len(q) - k + 1):
                    over[q[i : i + k]] = max(over[q[i : i + k]], b)
        for p, a in c.items():
            if len(p) < 2 or a < min_count or p in over and 100 * over[p] >= share * a:
                continue
            cuts = [(10**6 * a * a // (c[p[:j]] * c[p[j:]]), j) for j in range(1, len(p))]
            score, j = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), c[p[:j]], c[p[j:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed, n=60):
    rnd = random.Random(seed)
    vocab = ["New", "york", "City", "of", "the", "a", "é", "x\x85y", "中文", "b" * 300, "zz"]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rnd.randint(0, 40)))
        out.append((rnd.choice(["en", "de", None, "und"]), t))
    return out + [("en", None), ("en", ""), ("fr", "only once"), ("en", "new york city " * 50), ("en", " ... ,, \n")]


@pytest.mark.parametrize("head,words,top", [(co.HEAD, 3, 2000), (4, 3, 2000), (0, 3, 2000), (3, 4, 5), (co.HEAD, 2, 2000)])
def test_equals_plain_counting(spark, head, words, top):
    rows = texts(5)
    docs = spark.createDataFrame([(i, l, t, 1, "w") for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, h long, word string")
    got = co.collocations(docs, min_count=3, max_words=words, top=top, head=head)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, words, 50, top)


def test_repeated_rows_empty_table_and_awkward_texts(spark):
    data = cases.awkward()
    docs = spark.createDataFrame(data * 12, cases.DOCS)
    assert sorted(map(tuple, co.collocations(docs, top=50).collect())) == plain([(r[2], r[1]) for r in data] * 12, 10, 3, 50, 50)
    assert co.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [1 << 30, 8, 0.000001])
def test_tiles(monkeypatch, dense):
    monkeypatch.setattr(co, "DENSE", dense)
    rng = np.random.default_rng(2)
    a, b = (np.where(rng.random(20_000) < 0.1, -rng.integers(1, 9, 20_000), (rng.pareto(0.6, 20_000) * 20).astype(np.int64) % (1 << 20)) for _ in range(2))
    left, right, n = co.count_pairs(a, b)
    assert dict(zip(zip(left.tolist(), right.tolist()), n.tolist())) == Counter(zip(a.tolist(), b.tolist())) and len(n) == len(set(zip(a.tolist(), b.tolist())))


def test_scores_of_large_counts(spark):
    a, l, r = 9_876_543_210_987, 9_999_999_999_999, 12_345_678_901_234
    df = spark.createDataFrame([(a, [l, a], [r, a])], "f long, pre array<long>, suf array<long>").select(co._worst_cut(2).alias("c")).select("c.*")
    assert tuple(df.first()) == (10**6 * a * a // (l * r), 1, l, r)
