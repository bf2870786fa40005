import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamworks.llm import ngram_join, quality_rules

from . import cases


def base(text):
    w = cases.words(text)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] >= 2 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def plain_rules(rows, min_docs=quality_rules.MIN_DOCS, small_share=quality_rules.SMALL_SHARE, min_left=quality_rules.MIN_LEFT, long_docs=quality_rules.LONG_DOCS, by_row=False):
    norm = lambda x: " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in cases.words(x))
    hosts, at = defaultdict(set), defaultdict(set)
    for d, t, s in rows:
        who = (d, t) if by_row else t
        hosts[s].add(who)
        for x in (t or "").split("\n"):
            if cases.words(x):
                at[s, norm(x)].add(who)
    out = []
    for d, t, s in rows:
        n, chars, sym, dup, rep = base(t)
        gone, drop = 0, []
        for i, x in enumerate((t or "").split("\n")):
            w = len(cases.words(x))
            limit = min(min_docs, long_docs) if w >= quality_rules.LONG_WORDS else min_docs
            if w and len(at[s, norm(x)]) > (limit if small_share is None else min(limit, max(2, small_share * len(hosts[s])))):
                gone += w
                drop.append(i)
        failed = n < 50 or 100 * rep > 50 * n
        out.append((d, s, n, chars, sym, dup, rep, failed, tuple(drop), not failed and n - gone >= min_left * n))
    return Counter(out)


def spark_rules(docs, **o):
    got = quality_rules.verdicts(docs, **o).collect()
    return Counter((r.doc_id, r.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, tuple(r.drop_lines), r.kept) for r in got)


@pytest.mark.parametrize("o", [dict(), dict(min_docs=2), dict(min_docs=5, by_row=True, min_left=0.8), dict(min_docs=5, by_row=True, small_share=None)])
def test_rules_on_real_documents(spark, o):
    docs = cases.documents(spark, "sf0.01")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert spark_rules(docs, **o) == plain_rules(rows, **o)


@pytest.mark.parametrize("hosts", [quality_rules.BROADCAST_HOSTS, 0])
@pytest.mark.parametrize("by_row", [False, True])
def test_rules_on_awkward_documents(spark, monkeypatch, hosts, by_row):
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", hosts)
    data = cases.awkward() + [(30 + k, f"of a small host {k}\n" + "and all " * (k % 7 != 3), "en", "small", 0, 0, "") for k in range(5)]
    docs = spark.createDataFrame(data, cases.DOCS)
    want = plain_rules([(d, t, s) for d, t, _, s, *_ in data], by_row=by_row)
    assert spark_rules(docs, by_row=by_row) == want and any(drop for *_, drop, _ in want)
    assert quality_rules.clean(docs.limit(0)).count() == 0


def test_clean_keeps_columns_of_any_name(spark):
    body = lambda k: " ".join(f"t{k}v{i}" for i in range(60))
    rows = [(k, f"shared line\n{body(k)}", "h", k, -k, f"{k}", "x", None, k) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, d long, s long, _d string, th string, drop string, D_ long")
    got = quality_rules.clean(docs)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter((r[0], body(r[0]), *r[2:]) for r in rows)


def test_clean_removes_shared_lines_from_all(spark):
    body = lambda k: " ".join(f"t{k}v{i}" for i in range(60))
    rows = [(k, f"Share   this PAGE\n{body(k)}" if k % 2 else f"share this page\n{body(k)}", "en", "h", 0, 0, "") for k in range(30)]
    got = {r.doc_id: r.text for r in quality_rules.clean(spark.createDataFrame(rows, cases.DOCS)).collect()}
    assert got == {k: body(k) for k in range(30)}


def test_copies_are_one_document_and_depleted_documents_go(spark):
    """Thirty copies of a text stay; of thirty texts that share all but a word, all go; with by_row the copies go too."""
    lines = "\n".join(" ".join(f"l{i}w{j}" for j in range(10)) for i in range(8))
    rows = [(k, lines.replace("l", "c"), "en", "h", 0, 0, "") for k in range(30)] + [(100 + k, f"own{k}\n{lines}", "en", "h", 0, 0, "") for k in range(30)]
    docs = spark.createDataFrame(rows + [(500 + k, " ".join(f"z{k}v{i}" for i in range(60)), "en", "h", 0, 0, "") for k in range(99)], cases.DOCS)
    keep = lambda **o: {r.doc_id for r in quality_rules.clean(docs, **o).collect()}
    assert keep() == set(range(30)) | set(range(500, 599)) and keep(by_row=True) == set(range(500, 599))


@pytest.mark.parametrize("size", [60, 4000])
def test_repeated_passages_go_at_every_size_of_host(spark, size):
    """A line in 25 documents and a passage of 60 words in 8 go; in 20 and 5 documents they stay."""
    body = lambda k: " ".join(f"t{k}v{i}" for i in range(130))
    passage = lambda name: " ".join(f"{name}{i}" for i in range(60))
    planted = {"a line of the host": range(0, 25), "another line": range(5, 25), passage("p"): range(30, 38), passage("q"): range(40, 45), "word " * 48 + "end": range(46, 54)}
    rows = [(k, "\n".join([body(k), *[x for x, at in planted.items() if k in at]]), "en", "h", 0, 0, "") for k in range(size)]
    gone = {k: {"a line of the host"} for k in range(25)} | {k: {passage("p")} for k in range(30, 38)}
    got = {r.doc_id: r.text for r in quality_rules.clean(spark.createDataFrame(rows, cases.DOCS)).collect()}
    want = {k: "\n".join(x for x in t.split("\n") if x not in gone.get(k, ())) for k, t, *_ in rows if k not in range(46, 54)}
    assert {k: t for k, t in got.items() if k not in range(46, 54)} == want
    assert all(got[k].endswith("end") for k in range(46, 54))


def plain_components(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    return Counter((d, *x) for (d, _), x in zip(rows, cases.components(rows)))


@pytest.mark.parametrize("which", ["sf0.001", "sf0.01", "awkward", "empty", "ladder", "templates"])
def test_components_equal_brute_force(spark, which):
    if which == "ladder":  # many near copies of which only neighbours link, and a hub
        base = [f"b{i}" for i in range(120)]
        rows = [(100 - k, " ".join(base[: 120 - 3 * k] + [f"n{k}_{i}" for i in range(3 * k)])) for k in range(20)]
        rows += [(200 + k, " ".join(base[:5 + k] + [f"m{k}"] + base[6 + k :])) for k in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    elif which == "templates":  # one template with own parts of 2 to 30 per cent, in texts of 6 to 220 words: hot shingles, links between bands
        rnd = random.Random(8)
        rows = []
        for k in range(400):
            n = rnd.choice((6, 9, 40, 90, 95, 110, 200, 220))
            own = max(1, int(n * rnd.choice((0.02, 0.05, 0.1, 0.12, 0.16, 0.3))))
            rows.append((k, " ".join([f"t{i}" for i in range(n - own)] + [f"o{rnd.randint(0, 3)}x{i}" for i in range(own)])))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    elif which.startswith("sf"):
        docs = cases.documents(spark, which)
    else:
        docs = spark.createDataFrame(cases.awkward() if which == "awkward" else [], cases.DOCS)
    got = ngram_join.components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == plain_components(docs)


@pytest.mark.parametrize("repeats", [True, False])
def test_deduplicate_keeps_one_of_each_group(spark, repeats):
    docs = spark.createDataFrame([r for i, r in enumerate(cases.awkward()) if repeats or i != 5], cases.DOCS).selectExpr("*", "node AS d", "key AS T", "'x' AS th", "1 AS comp")
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 2, 3, 4, 6, 10, 20, 21, 22, 23], key=str)
    assert {r[-2:] for r in got} == {("x", 1)}
