from collections import Counter
from itertools import combinations

from loamworks.llm import decontaminate as dc

from . import cases


def test_masks_find_every_occurrence_with_its_substitutions():
    for n in range(1, dc.WINDOW + 1):
        masks = dc.ITEM_MASKS[max(low for low in dc.ITEM_MASKS if low <= n)]
        at = [frozenset(o + p for p in m) for m in masks for o in range(n - m[-1])]
        assert dc.substitutions(n) == n // 5
        assert all(any(not (set(s) & m) for m in at) for s in combinations(range(n), n // 5))
    assert dc.substitutions(500) == 4


def fold(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in cases.words(text)]


def holds(d, t):
    size = min(dc.WINDOW, len(t))
    need = size - size // 5
    return size > 0 and any(sum(d[i + k] == t[j + k] for k in range(size)) >= need for i in range(len(d) - size + 1) for j in range(len(t) - size + 1))


def plain(docs, items):
    """All windows of all pairs that share as many consecutive words as a match must have."""
    split = [(i, fold(t)) for i, t in items]
    least = lambda n: 3 if n >= 10 else 2 if n >= 5 else n
    grams = [{tuple(w[k : k + least(len(w))]) for k in range(len(w) - least(len(w)) + 1)} if w else set() for _, w in split]
    out = set()
    for d, t in docs:
        w = fold(t)
        own = {tuple(w[k : k + n]) for n in (1, 2, 3, 4) for k in range(len(w) - n + 1)}
        out |= {(d, i) for (i, x), g in zip(split, grams) if own & g and holds(w, x)}
    return out


def got(docs, items):
    return {(r.doc_id, r.item_id) for r in dc.overlaps(docs, items).collect()}


def test_on_real_tables(spark):
    docs, items = cases.documents(spark, "sf0.01"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(want) > 10 and got(docs, items) == want


def test_substitutions_short_items_and_awkward_rows(spark):
    item = [f"i{k}" for k in range(45)]
    sub = lambda w, at: [x if k not in at else "zz" for k, x in enumerate(w)]
    texts = {100: item, 101: sub(item, range(0, 45, 5)), 102: sub(item, range(0, 45, 3)), 103: item[7:27], 104: item[7:26], 105: sub(item[3:23], (0, 6, 12, 19)), 106: sub(item[3:23], (0, 5, 6, 12, 19)), 107: "a b c d e f g".split(), 108: "a b c d e f h".split(), 109: "a x c d e f h".split()}
    rows = cases.awkward() + [(k, "lead In " + " ".join(w).upper() + " tail off", "en", "s", 0, 0, "") for k, w in texts.items()]
    items = [(1, " ".join(item)), (2, "A b c d e f g"), (3, "too short"), (4, None), (None, "one two three four five"), (5, "One two"), (6, "tail"), (7, "")]
    docs, bench = spark.createDataFrame(rows, cases.DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = plain([(r[0], r[1]) for r in rows], items)
    assert {(100, 1), (101, 1), (103, 1), (105, 1), (107, 2), (108, 2), (6, None), (7, None), (4, 5), (6, 5), (106, 6)} <= want and (109, 2) not in want and got(docs, bench) == want
    docs = docs.selectExpr("*", "doc_id AS d", "text AS th", "'u' AS T_", "1 AS `t`")
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in {d for d, i in want if i not in (5, 6)})
    assert got(docs.limit(0), bench) == set() == got(docs, bench.limit(0))


def test_items_below_a_window_take_substitutions_anywhere(spark):
    rows, want = [], set()
    items = [(n, " ".join(f"m{n}x{k}" for k in range(n))) for n in range(1, dc.WINDOW)]
    for n, text in items:
        for most in (n // 5, n // 5 + 1):
            for s in combinations(range(n), most):
                if n < 10 or s[0] % 2 == 0 and s[-1] % 3 == 0:
                    d = len(rows)
                    rows.append((d, " ".join(["lead"] * (d % 5) + ["zz" if k in s else w for k, w in enumerate(text.split())] + ["tail"] * (d % 3))))
                    want |= {(d, n)} if most == n // 5 else set()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 500 and got(docs, bench) == want


def test_repeated_words_in_items_and_documents(spark):
    items = [(1, "a " * 30), (2, "b " * 7), (3, "a b " * 12), (4, "a " * 19 + "c")]
    rows = [(1, "a " * 3000), (2, "x " + "a " * 16 + "y y y y"), (3, "a " * 15 + "y y y y y"), (4, "b b b b b b x"), (5, "b b b x b x b"), (6, "b a " * 500), (7, "a " * 40 + "c " + "b " * 40), (8, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    full = {(r.doc_id, r.item_id): (r.start, r.end) for r in dc.overlaps(docs, bench).collect()}
    assert set(full) == plain(rows, items) and full[1, 1] == (0, 3000)


def test_given_items_below_a_window(spark):
    docs, bench = cases.documents(spark, "sf0.1"), spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    assert {(262, 11), (8287, 160), (8376, 101)} <= got(docs.filter("doc_id IN (262, 8287, 8376)"), bench)
