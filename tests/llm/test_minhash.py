import random

import numpy as np

from gapwise.llm import minhash
from gapwise.llm.graph import components


def brute(rows, k, percent):
    """id -> (n, component) by comparing all pairs; ids are distinct."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def made(seed):
    rng = random.Random(seed)
    rows, at = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, "oNE"), (5, "a b"), (6, "b a"), (7, "É x y z"), (8, "é x y z")], 10
    for _ in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
            rows.append((at, " ".join(w).upper() if rng.random() < 0.5 else "\n".join(w)))
            at += 1
    rows.append((at, " ".join(f"long{i}" for i in range(30_000))))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, k, percent in ((1, 3, 85), (2, 5, 80)):
        rows = made(seed)
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, n int")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_blocks_against_brute_force(spark, monkeypatch):
    for name, n in (("SMALL", 1), ("CHUNK", 3), ("BLOCK", 2), ("DENSE", 300)):
        monkeypatch.setattr(minhash, name, n)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(80)] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_odd_rows(spark):
    t = "the same words in a row"
    df = spark.createDataFrame([(None, t), (None, t), (7, t), (7, t), (7, "others"), (5, "others"), (None, "alone")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7, False), (None, 7, False), (7, 7, True), (7, 7, True), (7, 5, False), (5, 5, True), (None, None, True)], key=str)
    left = minhash.drop_near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("5", "others"), ("7", t), ("None", "alone")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (1, 2, 7, 100, 2000):
        s = minhash.fast_sketch(u[:n])
        assert (s != minhash._MOST).all()
    a, b = minhash.fast_sketch(u[:2000]), minhash.fast_sketch(u[500:2500])
    assert abs((a == b).mean() - 1500 / 2500) < 0.12


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(60)] + [(9, 9)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            top[find(a)] = find(b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(top)
    groups = {}
    for x in top:
        groups.setdefault(find(x), set()).add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_query(spark, sf):
    from gapwise.llm.queries import op1_minhash_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op1_minhash_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
