import numpy as np
import public_tokenizers as P
import pytest

from gapwise.llm import bpe, counts, ids, packing, quality

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
N = 10_000_000
RUNS = {"spaces": " " * N, "feeds": "x" + "\n" * N + " y", "letters": "a" * N}


@pytest.mark.parametrize("n", [70_000, 1_000_000])
def test_long_runs_are_the_library(n):
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(PLAIN), ids.ids(PLAIN)
    for x in (" " * n, "x" + " " * n, " " * n + "x", "x" + "\n" * n + " y", "　" * n + "1", "a" * n, "a." * 150_000 + "\t" * n + "'s" + "\x1c" * 70_000 + " b", "." * n):
        assert own.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name", RUNS)
def test_ten_million_as_jobs(spark, name):
    text = RUNS[name]
    want = ids.ids(PLAIN).encode(text)
    docs = spark.sql("SELECT 1L AS doc_id, concat('{}', repeat('{}', {}), '{}') AS text UNION ALL SELECT 2, 'short'".format(*{"spaces": ("", " ", N, ""), "feeds": ("x", "\\n", N, " y"), "letters": ("", "a", N, "")}[name]))
    got = {r.doc_id: (r.n_tokens, r.same) for r in bpe.transcode(docs, MULTI, P.PATTERN).join(docs, "doc_id").selectExpr("doc_id", "n_tokens", "decoded = cast(text AS binary) AS same").collect()}
    assert got[1][1] and got[2] == (len(bpe.encoding(MULTI, P.PATTERN).encode_ordinary("short")), True)
    pieces = packing.pack_documents(docs, PLAIN).where("doc_id = 1").selectExpr("sum(length) AS n", "max(doc_tokens) AS m", "count(DISTINCT start) = count(*) AS one").first()
    assert tuple(pieces) == (len(want) + 1, len(want) + 1, True)
    assert counts.section_counts(docs, PLAIN).where("doc_id = 1").selectExpr("sum(n_tokens)").first()[0] == len(want)


def test_null_ids_and_equal_texts_share_no_task(spark):
    n = 40_000
    docs = spark.range(n).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "IF(id % 4 = 0, 'the same words', concat('text ', id)) AS text").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.pack_documents(docs, PLAIN, 64).selectExpr("sequence_id >> 40 AS task", "length", "offset").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == n and got.groupby("task").size().max() < 1.3 * n / got.task.nunique() and got.task.nunique() > 1


def test_few_open_windows_still_pack_well():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 5000))[::-1].tolist()
    w = packing.OpenWindows(64, most=50)
    placed = w.place(lengths[:2000]) + w.place(lengths[2000:])
    used = {}
    for (k, at), n in zip(placed, lengths):
        used.setdefault(k, []).append((at, n))
    for x in used.values():
        end = 0
        for at, n in sorted(x):
            assert at == end
            end += n
        assert end <= 64


def test_longest_repeats():
    rng = np.random.default_rng(1)
    for n, kinds in [(0, 1), (1, 1), (200, 1), (300, 2), (300, 5), (400, 80)]:
        x = rng.integers(0, kinds, n)
        x = np.concatenate((x, x[: n // 3], x))
        x = np.unique(x, return_inverse=True)[1].astype(np.int32)
        text = [chr(200 + v) for v in x]
        want = []
        for i in range(len(x)):
            k = 0
            while i + k < len(x) and any("".join(text[j : j + k + 1]) == "".join(text[i : i + k + 1]) for j in range(len(x) - k) if j != i):
                k += 1
            want.append(k)
            if i > 60:
                break
        assert quality.repeat_lengths(x)[: len(want)].tolist() == want
    assert int(quality.repeat_lengths(np.zeros(1_000_000, np.int32)).max()) == 999_999
