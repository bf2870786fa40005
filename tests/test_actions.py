"""Scores of action streams on hand-made cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loamworks.operators.actions import ACTION, stream_score


def click(x, y, boxes=None, kind="click"):
    return {"type": kind, "x": x, "y": y, "boxes": [dict(zip(("left", "top", "width", "height"), b)) for b in boxes or []]}


def write(text):
    return {"type": "write", "text": text}


def key(*keys, kind="press"):
    return {"type": kind, "keys": list(keys)}


def scroll(amount=None, way=None):
    return {"type": "scroll", "amount": amount, "way": way}


ASKED = [click(0.25, 0.5), write("hello"), key("enter")]
CASES = [
    # gold, pred, total, first, n_gold, n_pred, scores by type
    (ASKED, [click(0.25, 0.5), write("HELLO "), key("Return")], 1.0, True, 2, 2, {"click": 1.0, "write": 1.0}),
    (ASKED, [key("escape")], 0.0, False, 2, 1, {"click": 0.0, "write": 0.0}),
    (ASKED, [], 0.0, False, 3, 0, {}),
    ([], [key("a")], 0.0, False, 0, 1, {}),
    (None, None, 0.0, False, 0, 0, {}),
    ([click(0.25, 0.25, [(0.2, 0.2, 0.2, 0.2)])], [click(0.35, 0.35)], 1.0, True, 1, 1, {"click": 1.0}),
    ([click(0.25, 0.25)], [click(0.25, 0.29, kind="CLICK")], math.exp(-120 * (0.04 - 0.01 * 2**0.5)), True, 1, 1, None),
    ([key("a"), key("b")], [key("a")], 0.5, True, 2, 1, {"press": 0.5}),
    ([key("a"), key("b")], [key("a"), key("b"), key("c")], 2 / 3, True, 2, 3, {"press": 2 / 3}),
    ([{"type": "wait", "seconds": 1.0}], [{"type": "wait", "seconds": 1.0}], 1.0, True, 1, 1, {"wait": 1.0}),
    # The key is used once: of two enters behind a write the second stays.
    ([write("a"), key("enter"), key("enter")], [write("a"), key("enter"), key("enter")], 1.0, True, 2, 2, {"write": 1.0, "press": 1.0}),
    # A predicted hotkey doesn't merge, an asked one does.
    ([write("abcdefghij"), key("enter", kind="hotkey")], [write("abcdefgh"), key("enter", kind="hotkey")], 0.5, True, 1, 2, {"write": 0.5}),
    ([write("abcdefghij")], [write("abcd")], 0.5, True, 1, 1, {"write": 0.5}),
    ([scroll(-10.0)], [scroll(-5.0)], 0.5, True, 1, 1, None),
    ([scroll(-10.0)], [scroll(5.0)], 0.0, True, 1, 1, None),
    ([scroll(way="down")], [scroll(-5.0)], 1.0, True, 1, 1, None),
    ([scroll(way="Up ")], [scroll(way="3.5")], 1.0, True, 1, 1, None),
    ([scroll(0.0)], [scroll(0.0)], 1.0, True, 1, 1, None),
    ([{"type": "terminate", "status": "success"}], [{"type": "terminate", "status": "success"}, key("a")], 0.5, True, 1, 2, {"terminate": 0.5}),
    ([{"type": "terminate", "status": "success"}], [{"type": "terminate", "status": "failure"}], 0.0, True, 1, 1, {"terminate": 0.0}),
    ([{"type": "terminate", "status": "success"}, key("a")], [key("a")], 0.0, False, 2, 1, {"terminate": 0.0}),
    ([key("a"), {"type": "terminate", "status": "success"}], [key("a"), key("b")], 1.0, True, 2, 2, {"press": 1.0}),
]


def test_streams(spark):
    text = lambda a: None if a is None else json.dumps(a)
    df = spark.createDataFrame([(i, text(c[0]), text(c[1])) for i, c in enumerate(CASES)], "i int, g string, p string")
    got = df.select("i", stream_score(F.from_json("g", f"array<{ACTION}>"), F.from_json("p", f"array<{ACTION}>")).alias("s")).select("i", "s.*").orderBy("i").collect()
    for row, (gold, pred, total, first, n_gold, n_pred, by_type) in zip(got, CASES):
        assert row.total == pytest.approx(total), (gold, pred)
        assert (row.first, row.n_gold, row.n_pred) == (first, n_gold, n_pred), (gold, pred)
        if by_type is not None:
            assert {t.type: t.score for t in row.by_type} == pytest.approx(by_type)
