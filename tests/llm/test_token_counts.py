import random

import public_tokenizers
import sentencepiece

from loamworks.llm import token_counts as tc

from . import cases

PATH = public_tokenizers.path(tc.MODEL)


def library(texts):
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [len(x) for x in m.encode(texts, num_threads=1)]


def test_random_and_odd_texts():
    rnd = random.Random(7)
    texts = ["", " ", "  ", "\n", " \n", "\n ", "a  b", "a   b ", "  a", "▁a b▁▁c", "</s> <s> <unk> <0x0A>", "a\x00b", " " * 50 + "x", " " * 33, "é中🙂 　x", "a" * 3000, "ab" * 700, "=" * 100, "-" * 77, " \n  \n   \n", "🙂 🙂  🙂", " 中  中", "\r\n\t x"]
    for alphabet in ("ab ", "the and of ing\n ", "abcdefgh   \n", "aé中🙂 ▁-=_.,0123", "абв \n", "e t a o ", "=-*#/. "):
        for _ in range(150):
            texts.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 90))))
    got = tc.merger(PATH).tokens(texts).tolist()
    assert [(t, n) for t, n in zip(texts, got)] == list(zip(texts, library(texts)))


def test_documents(spark):
    docs = cases.documents(spark, "sf0.01")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], library([r.text or "" for r in rows])))
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, PATH).collect()} == want


def test_awkward(spark):
    data = cases.awkward()
    docs = spark.createDataFrame(data, cases.DOCS)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tc.count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted(zip([r[0] for r in data], [len((r[1] or "").encode()) for r in data], library([r[1] or "" for r in data])), key=str)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
