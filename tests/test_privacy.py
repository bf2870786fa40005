"""Privacy flags of the query and of its SQL on texts in which numbers and words touch."""

import duckdb
import pytest

from loamworks import registry

TEXTS = {
    # text: reasons
    "+1 (605) 555-9305 4078918989542222 x": "payment_card",
    "12 4111 1111 1111 1111": "",
    "12345678 4111 1111 1111 1111": "",
    "4111-1111-1111-1111 4111 1111 1111 1112": "payment_card",
    "4111 1111 1111 1112 4111 1111 1111 1111": "payment_card",
    "123456789012345678901234 4111111111111111": "payment_card",
    "<4111>1111<1111>1111": "",
    "4111  1111 1111 1111": "",
    "0000 0000 0000 0000": "",
    "mail A.B@C.ORG": "email",
    "mail a@b.oKx": "email",
    "a@b.Kkx": "",
    "Password\x0bis\x0bhunter22": "labeled_secret",
    "paſſword: hunter22": "",
    "épassword: hunter22": "",
    "épassword: hunter22": "labeled_secret",
    "passwordis hunter22": "",
    "my_secret=hunter22": "",
    "TEL:\x0b+49 (0) 123 456": "labeled_phone",
    "1-123-45-6789": "ssn",
    "123-45-67890": "",
    "": "",
    None: "",
}


@pytest.mark.parametrize("name", ["flt_privacy", "flt_privacy_group", "ss_screen"])
def test_query_and_sql_agree_on_touching_numbers(spark, tmp_path, name):
    docs = spark.createDataFrame([(i, t, f"s{i}", 0) for i, t in enumerate(TEXTS) if t is not None], "doc_id long, text string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such entry")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    key = list(want.columns)[0]
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()
    if name == "flt_privacy":
        for row in got.to_dict("records"):
            text = list(TEXTS)[row["doc_id"]]
            assert ",".join(k for k in ("email", "labeled_phone", "labeled_secret", "payment_card", "ssn") if row[k]) == TEXTS[text], text
