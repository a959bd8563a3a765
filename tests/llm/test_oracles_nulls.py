import duckdb

from gapwise.llm import queries

HARD = r"\### Assistant: </turn> ok"


def test_op10_with_nulls(spark, tmp_path):
    """Null turns come first in Spark and in SQL; null roles, texts and ids, repeated turns and rows."""
    texts, roles = [None, "", HARD, "é🙂\n", "a:b"], ["user", "assistant", None]
    rows = [(c, t, roles[(k + t0) % 3], texts[(2 * k + t0) % 5]) for k, c in enumerate([None, 1, 2, 3, 3]) for t0, t in enumerate([2, None, 0, None, 1, 1, 0])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op10_chat_format"])
    names = [c[0] for c in want.description]
    got = queries.queries()["op10_chat_format"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and len(got) == 5
