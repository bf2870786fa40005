"""Alignment against a plain form that cuts texts where both tokenizers end a token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loamworks.llm import token_alignment as ta

from . import cases

A, B = public_tokenizers.path(ta.TOKENIZER_A), public_tokenizers.path(ta.TOKENIZER_B)


def byte_chars():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, n = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(n)] = b
            n += 1
    return out


def plain(texts):
    """Per text the groups as (A ids, B ids), from the libraries alone."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    of = byte_chars()
    out = []
    for text in texts:
        groups = []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = m.encode(text)
            x = [t.id_to_token(i).encode() if t.id_to_token(i) == "<|endoftext|>" else bytes(of[c] for c in t.id_to_token(i)) for i in a]
            y = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends_a, ends_b = [sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 500 else None, None
                if ends_a is None:
                    ends_a, n = [], 0
                    for p in x:
                        n += len(p)
                        ends_a.append(n)
                ends_b, n = [], 0
                for p in y:
                    n += len(p)
                    ends_b.append(n)
                both, i, j = sorted(set(ends_a) & set(ends_b)), 0, 0
                for e in both:
                    k, l = i, j
                    while i < len(a) and ends_a[i] <= e:
                        i += 1
                    while j < len(b) and ends_b[j] <= e:
                        j += 1
                    groups.append((a[k:i], b[l:j]))
        out.append(groups)
    return out


def results(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each row."""
    found = plain([t or "" for _, t in rows])
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    docs = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (d, _), g, c in zip(rows, found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()), sha))
    return out


def test_random_and_odd_texts():
    rnd = random.Random(11)
    texts = ["", " ", "  ", "\n", "a", " a", "a\n", "\na", "a  b", "▁a", "x ▁ y", "</s> <s> <unk> <0x0A> <|endoftext|>", "a\x00b", "é中🙂 　x", "🙂🙂 🙂", "a" * 3000, "=" * 5000, "ab\tcd e", "it's we'll don't", "\r\n x", "x\x85y z", "中文" * 300]
    for alphabet in ("ab ", "the and of ing\n ", "aé中🙂 -=_.,0123", "абв \n", "=-*#/. ", "<|endoftext|> </s>"):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120))) for _ in range(80)]
    al = ta.aligner(A, B)
    got = al(texts)
    for i, (t, g) in enumerate(zip(texts, plain(texts))):
        want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()
        assert (t, got.shown[i]) == (t, want)
        assert (got.n_a[i], got.n_b[i], got.n_groups[i], got.n_links[i]) == (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g)), t
    whole = al.whole(texts)
    assert whole.shown == got.shown and (whole.key == got.key).all() and (whole.weight == got.weight).all()


def test_long_group_equals_short_ones(monkeypatch):
    al, texts = ta.aligner(A, B), ["中文🙂 x" * 50, "ab ba"]
    want = al.whole(texts)
    monkeypatch.setattr(ta, "LONG_GROUP", 0)
    got = al.whole(texts)
    assert all((x == y).all() for x, y in zip((want.n_pairs, want.key, want.weight), (got.n_pairs, got.key, got.weight)))


@pytest.mark.parametrize("hot", [ta.HOT, 100, 0])
def test_documents(spark, hot):
    docs = cases.documents(spark, "sf0.001")
    got = sorted(tuple(r) for r in ta.align_documents(docs, A, B, hot)[0].collect())
    assert got == sorted(results([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_awkward(spark):
    data = cases.awkward()
    docs = spark.createDataFrame(data, cases.DOCS)
    out, pairs = ta.align_documents(docs, A, B)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(results([(r[0], r[1]) for r in data]), key=str)
    assert pairs.columns == ["a", "b", "n", "best"]
    assert ta.align_documents(docs.limit(0), A, B)[0].count() == 0
