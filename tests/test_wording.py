"""Wordings and session units on odd conversations, beside their SQL."""

import duckdb
import pytest

from quillgraph import queries

WORDS = ("test", "fix", "error", "not", "never", "secret", "design", "why does", "release", "disable", "skip")
ROWS = [(c, t, "user" if (c + t) % 3 else "assistant", before + WORDS[(c * 7 + t) % len(WORDS)].upper() + after if t % 2 else before + WORDS[(c * 5 + t) % len(WORDS)] + after)
        for c, (before, after) in enumerate([("é", "é"), ("ça ", "ère"), ("ß", ""), ("", "ç"), ("_", ""), ("", "9"), ("a ", "́"), ("", ""), ("漢", "字"), ("ſ ", " ſ")]) for t in range(8)]
ROWS += [(50, 0, "user", "teſt"), (50, 1, "user", "diſable"), (50, 2, "user", "\u212aeep ſecret"), (51, 0, "user", None), (51, 1, "assistant", "fix it"), (51, 2, None, "x"), (52, 0, "assistant", "y"), (52, 1, "user", None),
         (53, 0, "user", ""), (54, 0, "user", '{"exit_code": 1}'), (55, 0, "user", "a\nfix\r\nb"), (56, 0, "user", "İtest İmplement")]


@pytest.mark.parametrize("name", ["f11_phase", "w1_session_units", "a5_unit_counts"])
def test_odd_conversations_match_sql(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))
