import corpus_pipeline as C
from test_lines import brute as lines_brute
from test_minhash import brute as groups_brute
from test_suffixes import brute as passages_brute
from test_suffixes import texts_of
from test_tokens import check_packed


def differing(df, want):
    """Ids whose text is not the wanted one; texts are too long to print."""
    got = {r.doc_id: r.text for r in df.collect()}
    return sorted(i for i in got.keys() | want.keys() if got.get(i) != want.get(i))


def test_stages_against_brute_force(spark, sf, tmp_path):
    def written(df):
        df.write.parquet(to := f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
        return spark.read.parquet(to)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    by = dict(C.STAGES)
    out = written(by["language ID"](spark, docs, sf))
    assert out.columns == names
    rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    assert differing(out, rows) == []

    out = written(by["line dedup"](spark, out, sf))
    kept = {i: (gone, t) for i, (_, gone, t) in lines_brute(list(rows.items()), 20).items()}
    rows = {i: t for i, (gone, t) in kept.items() if not gone or t.split()}
    assert out.columns == names
    assert differing(out, rows) == []
    assert all(r.n_chars == len(r.text) and r.source for r in out.collect())

    out = written(by["MinHash near-dedup"](spark, out, sf))
    groups = groups_brute(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    assert out.columns == names
    assert differing(out, rows) == []

    out = written(by["suffix-array dedup"](spark, out, sf))
    left = texts_of(list(rows.items()))
    kept = {i: (starts, left[i]) for i, (_, starts, _, _) in passages_brute(list(rows.items())).items()}
    rows = {i: t for i, (starts, t) in kept.items() if not starts or t.split()}
    assert out.columns == names
    assert differing(out, rows) == []

    out = written(by["packing"](spark, out, sf))
    check_packed(out.collect(), list(rows.items()), 1024)
    assert sorted(map(tuple, C.run(spark, sf).select("doc_id", "start", "length").collect())) == sorted(map(tuple, out.select("doc_id", "start", "length").collect()))


def test_empty_and_odd_rows(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score double"
    rows = [(1, None, None, None, None, "a", 1.0), (None, "the same words", None, None, 0, None, None), (3, "", "en", "s", 0, "b", 2.0), (4, "the same words " * 3000, "en", "s", 5, "c", 3.0), (4, "the same words", "en", "s", 5, "c", 3.0), (4, "the same words", "en", "s", 5, "c", 3.0)]
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES:
            stage(spark, docs, sf).write.parquet(to := f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(to)
            if name != "packing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "score"]
            n = docs.count()
            assert n == 0 if not data else n > 0
