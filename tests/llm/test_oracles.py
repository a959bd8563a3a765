import duckdb
import pytest

from gapwise.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    pick = lambda columns, rows: sorted(tuple(r[columns.index(c)] for c in sorted(names)) for r in rows)
    a, b = pick(got.columns, got.collect()), pick(names, want.fetchall())
    assert len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 0
