import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamworks.llm import token_ids as ti

from . import cases

PATH = public_tokenizers.path(ti.TOKENIZER)


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, ti.END_ID] for x in texts]


def test_encoder_equals_library():
    rnd = random.Random(3)
    texts = ["", " ", "a", " a", "a ", "a\nb", "a\n\nb", "a \nb", "a\n b", "don't 've", "x<|endoftext|>y z", "a\tb  c", "a\x00b c", "\x00 a", "a　b c", "a\x1cb c\x85d", "12 345 é中🙂", "I'm we'll\nThe 's 't"]
    for alphabet in ("ab ", "ab \n", "the of 12,.'s\n ", "é中🙂 \t a"):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    ids, n = ti.Encoder(PATH)(texts)
    assert np.split(ids, np.cumsum(n)[:-1])[5].tolist() == library(texts)[5]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library(texts)


@pytest.mark.parametrize("n", [0, 1, 31, 33, 16384, 16385, 100_003])
def test_segment_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 50_257, np.full(n, 7), rng.integers(0, 50_257, n)):
        ids = ids.astype(np.uint32)
        data = ti.encode_segment(ids)
        assert (ti.decode_segment(data) == ids).all()
        size = ti.LANES * ti.STEPS
        for b in range(-(-n // size)):
            assert (ti.decode_segment(data, b) == ids[b * size : (b + 1) * size]).all()
        if n > 40:
            bad = bytearray(data)
            bad[-9] ^= 4
            with pytest.raises(ValueError):
                ti.decode_segment(bytes(bad))
            assert len(data) < 4 * n + 9000 + 8 * len(set(ids.tolist()))


def digest(rows):
    out, start = [], 0
    for d, ids in rows:
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark):
    docs = cases.documents(spark, "sf0.01")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = ti.read_ids(ti.write_ids(docs, PATH)).orderBy("start").collect()
    assert [tuple(r) for r in got] == digest(zip([d for d, _ in rows], library([t for _, t in rows])))


def test_awkward(spark):
    data = cases.awkward()
    got = [tuple(r) for r in ti.read_ids(ti.write_ids(spark.createDataFrame(data, cases.DOCS), PATH)).collect()]
    want = zip([r[0] for r in data], library([r[1] for r in data]))
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == sorted(((d, n, c) for d, _, n, c in digest(want)), key=str)
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()] and [r[0] or 0 for r in got] == sorted(r[0] or 0 for r in data)
    assert ti.read_ids(ti.write_ids(spark.createDataFrame([], cases.DOCS), PATH)).count() == 0
