from collections import Counter

import pytest

import corpus_pipeline
from loamworks.llm import mixing

from . import cases
from .test_decontaminate import plain
from .test_rules_and_join import plain_rules


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_stages_equal_plain_forms(spark, sf):
    """Each stage on what its predecessor kept, against the plain form of its operator."""
    sf_dir = f"/root/testdata/{sf}"
    docs = cases.documents(spark, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing", "sharding"]

    out = stages["quality rules"](spark, docs, sf_dir)
    verdict = plain_rules([(r.doc_id, r.text, r.source) for r in rows.values()])
    one = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(one) == {v[0] for v in verdict if v[-1]}
    assert all(r.n_chars == len(r.text) for r in one.values())

    docs = spark.createDataFrame(list(one.values()), docs.schema)
    out = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    comps = cases.components([(r.doc_id, r.text) for r in one.values()])
    two = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(two) == {d for d, (_, c) in zip(one, comps) if d == c}

    docs = spark.createDataFrame(list(two.values()), docs.schema)
    out = stages["benchmark decontamination"](spark, docs, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    bad = {d for d, _ in plain([(r.doc_id, r.text) for r in two.values()], [(r.item_id, r.text) for r in items])}
    three = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and bad and set(three) == set(two) - bad

    docs = spark.createDataFrame(list(three.values()), docs.schema)
    out = stages["mixing"](spark, docs, sf_dir)
    four = out.collect()
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in four) == Counter({r.doc_id: r.copies for r in mixing.plan(docs).collect() if r.copies})

    final = stages["sharding"](spark, spark.createDataFrame(four, docs.schema), sf_dir).collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in four)
    loads = Counter(r.shard for r in final)
    assert max(loads.values()) - min(loads.values()) <= 1
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in run) == Counter((r.doc_id, r["size"], r.text_crc32) for r in final)


CLASHES = "d s t th drop n row times like k m copy key_ grp shard slot size comp _d _th first".split()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_tables(spark, tmp_path, stage):
    """Nulls in every column, empty and very long texts, ties, repeats, clashing columns, and no rows at all."""
    item = " ".join(f"q{i}" for i in range(9_000, 9_030))
    items = [(1, item), (None, None), (2, ""), (3, "one two"), (4, "no such words are in any")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(cases.awkward() + [(None,) * 7, (None,) * 7], cases.DOCS)
    docs = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
    run = dict(corpus_pipeline.STAGES)[stage]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    out = run(spark, docs, str(tmp_path))
    got = Counter(r.doc_id for r in out.collect())
    if stage == "sharding":
        assert got == Counter(d for d, *_ in rows) and out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
        loads = Counter(r.shard for r in out.collect())
        assert max(loads.values()) - min(loads[s] for s in range(16)) <= 1
    else:
        assert out.columns == docs.columns and all(r.comp == "x" and r._th == "x" for r in out.collect())
        if stage == "quality rules":
            want = Counter(d for (d, *_, kept), n in plain_rules(rows).items() for _ in range(n * kept))
        elif stage == "n-gram Jaccard join":
            want = Counter([1, 2, 3, 4, 6, 10, 20, 21, 22, 23, None])
        elif stage == "benchmark decontamination":
            want = Counter(d for d, *_ in rows if d != 20)
        else:
            want = Counter()
            for r in mixing.plan(docs).collect():
                want[r.doc_id] += r.copies
            want = +want
        assert got == want
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
