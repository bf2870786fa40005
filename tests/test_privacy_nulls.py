"""Groups and screened documents with null texts, null sources and characters beyond ASCII, against their SQL."""

import duckdb
import pytest

from loamworks import registry

DOCS = [
    (1, None, "a"), (2, "clean", None), (52, None, None), (3, "mail a@b.org", "a"), (53, "clean", None), (4, "mail a@b.org", "b"), (54, None, "b"), (5, "", "c"),
    (6, "The secret  entry　here", "d"), (7, "the secret\x0bentry\x85here", "e"), (8, "THE SECRET ENTRY HERE", "f"), (9, " ", "g"),
    (10, "𝒳password: hunter22", "h"), (11, "𝒳 password: hunter22", "h"), (12, "𝟙tel: +49 123 456 789", "h"), (13, "ΟΔΟΣΑ", "i"), (14, "ΟΔΟΣ İSTANBUL", "i"),
]


@pytest.mark.parametrize("name", ["flt_privacy_group", "ss_screen"])
def test_null_texts_null_sources_and_wide_spaces(spark, tmp_path, name):
    spark.createDataFrame([(*d, 0) for d in DOCS], "doc_id long, text string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "secret entry  here "), (2, None), (3, ""), (4, "　"), (5, "ΟΔΟΣ"), (6, "istanbul")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if name == "ss_screen":
        assert {r[0]: (r[1], r[3]) for r in got} == {d: ({14: 2}.get(d, int(d in (6, 7, 8, 13))), d not in (3, 4, 6, 7, 8, 11, 13, 14)) for d, _, _ in DOCS}
    else:
        assert {r[0]: r[-1] for r in got}[None] == 3 and {r[0]: r[-2] for r in got}["a:1"] is False
        assert {r[0]: r[1] for r in got} == {"a:1": 1, "a:3": 1, None: 3, "b:4": 2, "c:5": 1, "d:6": 1, "e:7": 1, "f:8": 1, "g:9": 1, "h:10": 1, "h:11": 1, "h:12": 1, "i:13": 1, "i:14": 1}
        assert {r[0] for r in got if r[-2]} == {"a:3", "b:4", "h:11"}
