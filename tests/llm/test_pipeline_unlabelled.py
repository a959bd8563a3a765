import corpus_pipeline as C


def test_unlabelled_documents_stay(spark, sf):
    rows = [(1, "some words here", None, "s"), (2, "123 -- \n", None, "s"), (3, None, None, "s"), (4, "日本語", None, None), (5, "", None, "s"), (None, "É", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = C.language(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(rows[k]) for k in (0, 3, 5))
