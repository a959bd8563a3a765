import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gapwise.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, k):
    tf = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in tf:
            m = 10 + 90 * sum(c.values()) * n // total if total else 10
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def check(spark, docs, items, k=10, parts=3, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, score long").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in S.search(d, q, k, **options).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, items, k), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "é", "Étude", "x1", "1", "don't", "a_b", "naïve", "日本", "z"] + [f"w{k}" for k in range(60)]
    text = lambda: rng.choice(["", " ", "-"]).join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(1, 40)))
    docs = [(k * 7 % n, text()) for k in range(n)]
    docs += [(3, docs[3][1]), (None, docs[0][1]), (None, "w1 w2"), (5000, None), (5001, ""), (5002, "--- ...")]
    items = [(k, text()) for k in range(25)] + [(1, "w3 w4"), (2, "w3 w4"), (2, "w3 w4"), (77, None), (78, ""), (79, "nowhere")]
    return docs, items


def test_against_brute_force(spark):
    check(spark, *made(1, 400))


def test_small_windows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", 50)
    check(spark, *made(2, 300), k=3, window=16, block=400)


def test_ties_go_by_id_and_null_comes_last(spark):
    docs = [(k, "same words here") for k in range(50, 0, -1)] + [(None, "same words here")] * 3 + [(900 + k, "other") for k in range(200)]
    check(spark, docs, [(1, "same")], parts=5)
    check(spark, docs[45:60], [(1, "same")], k=40)


def test_nothing(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a b"), (2, None)], [])
    check(spark, [(1, "..."), (2, None)], [(1, "a")])


def test_very_long_texts(spark):
    docs = [(1, "word " * 700_000 + "end"), (2, "x" * 3_000_000), (3, " " * 3_000_000 + "word"), (4, "end")]
    check(spark, docs, [(1, "word end"), (2, "x" * 3_000_000)])


def test_length_factor_is_exact_past_64_bits():
    size = np.array([1, 10**7, 3 * 10**7], np.int64)
    n, length = 10**11, 4 * 10**13 + 7
    assert S.length_factor(size, n, length).tolist() == [10 + 90 * s * n // length for s in size.tolist()]


def test_rows_and_row_groups_of_the_index_are_small(spark, tmp_path):
    import pyarrow.parquet as pq

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.concat(F.lit("w"), (F.col("doc_id") * 31 + k).cast("string"))), " ")
    docs = spark.range(6000).select(F.col("id").alias("doc_id")).select("doc_id", text.alias("text")).coalesce(1)
    S.build_index(docs).write.options(**S.FILES).parquet(f"{tmp_path}/index")
    rows = spark.read.parquet(f"{tmp_path}/index").select(F.octet_length("slots").alias("a"), F.octet_length("tfs").alias("b"), "n_docs").collect()
    assert sum(r.n_docs for r in rows) == 6000 and sum(r.a for r in rows) == 2 * 2_400_000 and max(r.a + r.b for r in rows) < 4 << 20
    groups = [pq.ParquetFile(f).metadata.row_group(g).total_byte_size for f in (tmp_path / "index").glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 24 << 20
