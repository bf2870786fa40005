"""Readers on awkward files, and streaming jobs with late rows and restarts."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamworks.sources import readers, stages
from loamworks.streaming import jobs


def test_json_lines_skip_blanks_and_keep_what_is_refused_apart(spark, tmp_path):
    good = [{"text": "one", "source": "s", "doc_id": "d1", "license": "mit", "meta": {"a": "b"}}, {"content": "two\r\nlines", "id": "d2"}, {"code": "x = 1"}, {"text": "é" * 300}]
    lines = [json.dumps(good[0]), "", "   ", json.dumps(good[1]), json.dumps(good[2]), json.dumps(good[3]), "{broken", json.dumps({"title": "no text"}), json.dumps({"text": None})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl"), 500).collect()
    assert Counter(r.state for r in got) == {"ok": 3, "oversize": 1, "malformed": 1, "no_text": 2}
    ok = {r.text: r for r in got if r.state == "ok"}
    assert set(ok) == {"one", "two\r\nlines", "x = 1"} and all(r.text is None for r in got if r.state != "ok")
    assert (ok["one"].doc_id, ok["one"].source, ok["one"].license, ok["one"].meta) == ("d1", "s", "mit", {"a": "b"})
    assert ok["two\r\nlines"].doc_id == "d2" and ok["x = 1"].doc_id is None and ok["x = 1"].source.endswith("a.jsonl") and ok["x = 1"].license == "unknown"
    ids = {r.text: r.doc_id for r in readers.identified(spark.createDataFrame([(t, r.doc_id) for t, r in ok.items()], "text string, doc_id string")).collect()}
    assert ids["one"] == "d1" and len(ids["x = 1"]) == 64


def test_text_files_are_a_document_each(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("first\n\nline", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_text("second", encoding="utf-8")
    (tmp_path / "c.bin").write_text("not read", encoding="utf-8")
    got = {r.source.split("/")[-1]: r.text for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "first\n\nline", "b.md": "second"}
    with pytest.raises(Exception, match="exceeds 10 bytes"):
        readers.text_files(spark, str(tmp_path), 10).collect()


def test_function_calls_and_their_quarantine(spark):
    tool, call = '[{"name":"b","description":"d"},{"name":"a"}]', '[{"name":"b","arguments":{"x":1}},{"name":"a"}]'
    rows = [(1, "ask", tool, call), (2, "", tool, call), (3, "ask", "[]", call), (4, "ask", tool, "[{broken"), (5, "ask", tool, '[{"name":"","arguments":{}}]'), (6, "ask", tool, '[{"name":"a","arguments":"text"}]'), (7, None, None, None), (8, "ask", '{"name":1', call)]
    good, bad = readers.function_calls(spark.createDataFrame(rows, "row_id long, query string, tools string, answers string"))
    one = good.collect()
    assert len(one) == 1 and one[0].row_id == 1 and [t.name for t in one[0].tools] == ["a", "b"]
    user, reply = one[0].messages
    assert (user.role, user.content, reply.role) == ("user", "ask", "assistant") and [(c.name, json.loads(c.arguments)) for c in reply.tool_calls] == [("b", {"x": 1}), ("a", {})]
    assert {r.row_id: r.reason for r in bad.collect()} == {2: "query", 3: "tools", 4: "answers", 5: "answers", 6: "answers", 7: "query", 8: "tools"}


def test_shared_folder_is_required_off_local():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        stages.shared_dir(Session())


def events(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(hours=h), u, "view", float(v)) for i, h, u, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_windows_close_and_late_rows_are_dropped(spark):
    """Watermark of an hour; three parts in time order, then rows of a closed window and of an open one."""
    parts = [events(spark, [(1, 1, 1, 10), (2, 20, 1, 90)]), events(spark, [(4, 30, 1, 10), (5, 40, 2, 10)]), events(spark, [(7, 50, 1, 10)]), events(spark, [(8, 2, 1, 10), (10, 49, 1, 10)])]
    stream, job = jobs.arriving(spark, parts), jobs.Job(spark, "late")
    first = job.append(jobs.deadline_windows(stream, 50.0))
    got = {r.window_start: (r.n, r.on_time, r.successes) for r in first.collect()}
    assert got == {"2024-01-01 00:00:00": (2, 1, 1), "2024-01-02 00:00:00": (2, 2, 2)}  # the third day stays open
    again = job.append(jobs.deadline_windows(stream, 50.0))
    assert again.count() == 2  # a restart adds nothing
    progress = [r for r in first.collect()]
    assert len(progress) == 2


def test_sessions_close_after_a_gap_and_late_rows_open_none(spark):
    parts = [events(spark, [(1, 0, 1, 1), (2, 5, 1, 2), (3, 12, 1, 4)]), events(spark, [(4, 30, 2, 8)]), events(spark, [(5, 60, 1, 16)]), events(spark, [(6, 1, 1, 100), (7, 3, 3, 100)])]
    got = {(r.user_id, r.session_start): (r.steps, r.total) for r in jobs.Job(spark, "sessions").append(jobs.sessions(jobs.arriving(spark, parts))).collect()}
    assert got == {(1, "2024-01-01 00:00:00"): (2, 3.0), (1, "2024-01-01 12:00:00"): (1, 4.0), (2, "2024-01-02 06:00:00"): (1, 8.0)}


def test_screening_of_a_batch(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org"), (2, "the secret words here are"), (3, "clean"), (4, None)], "doc_id long, text string")
    deny = spark.createDataFrame([("secret words here",)], "entry string")
    got = {r.doc_id: (r.entries, r.reasons, r.kept) for r in jobs.screen(docs, deny).collect()}
    assert {k: v for k, v in got.items() if k < 4} == {1: (0, "email", False), 2: (1, "", False), 3: (0, "", True)}
    assert jobs.screen(docs.limit(0), deny).count() == 0
