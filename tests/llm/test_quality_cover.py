from gapwise.llm import quality as Q


def test_cover_alone_rejects(spark):
    parts = [" ".join(f"p{k}w{i}" for i in range(18)) for k in range(2)]
    rest = " ".join(f"v{i}" for i in range(328))
    rows = [(1, f"{parts[0]} {parts[1]} {rest} {parts[0]} x {parts[1]}"), (2, f"{parts[0]} {rest} {parts[0]}")]
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.15 * got[1].n_words < got[1].covered_words <= 0.2 * got[1].n_words
    assert not got[1].base_failed and got[1].longest_repeat <= 50 and not got[1].kept
    assert got[2].kept
