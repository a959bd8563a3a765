from gapwise.llm import lines


def test_rows_that_differ_in_a_carried_column(spark):
    text = "the very same line of text, first half\nsomething else"
    rows = [(1, text, "a"), (1, text, "b"), (2, "the very same line of text, first help\nmore", "a"), (3, "the very same line of text, first half", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.source, r.n_removed, r.kept_text) for r in lines.dedup_lines(df, carry=("source",)).collect())
    assert got[:2] == [(1, "a", 0, text), (1, "b", 0, text)]
    assert got[3] == (3, "c", 1, "")


def test_carried_columns_change_no_result(spark):
    near = "a line of more than twenty characters"
    rows = [(1, f"{near}\n{near}s\nabc", "a"), (1, f"{near}\n{near}s\nabc", None), (2, f"{near[:-1]}\nnew words", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = sorted(tuple(r) for r in lines.dedup_lines(df).collect())
    carried = sorted(tuple(r)[:4] for r in lines.dedup_lines(df, carry=("source",)).collect())
    assert plain == carried and [r[2] for r in plain] == [1, 1, 1]
