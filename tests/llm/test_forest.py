import math
import random

import numpy as np
import pytest

from gapwise.llm import forest


def brute(rows, bound=0.93):
    ok, top = [], {}
    for k, (i, v, label) in enumerate(rows):
        top[k] = k
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((k, np.array(v, float), label))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for n, (a, x, p) in enumerate(ok):
        for b, y, q in ok[:n]:
            if p == q and len(x) == len(y) and forest.unit(x[None])[0] @ forest.unit(y[None])[0] >= bound:
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {rows[k][0]: (links[k], least[find(k)]) for k in range(len(rows))}


def made(seed, n, d):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            old = rows[rng.integers(len(rows))]
            rows.append((i, (np.array(old[1]) + rng.normal(0, rng.choice([0, 0.02, 0.05]), d)).tolist(), old[2]))
        else:
            rows.append((i, rng.normal(0, 1 / d**0.5, d).tolist(), int(rng.integers(3))))
    return rows


def recall(got, want):
    total = sum(x[0] for x in want.values())
    return sum(got[i][0] for i in want) / total if total else 1.0


def test_recall_and_precision(spark):
    rows = made(1, 1500, 24)
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(df, leaf=16).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the bound, none twice
    assert recall(got, want) >= 0.97


def pairs_near(x, bound=0.93):
    """Links of each row, compared in full."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (u @ u.T >= bound).sum(1) - 1


@pytest.mark.parametrize("d", [64, 384])
def test_deep_trees(spark, monkeypatch, d):
    """Depth 8 and more, pairs close to the bound, one crowded group: recall, precision, copies and widths."""
    rng = np.random.default_rng(d)
    x = rng.normal(0, 1, (5000, d))
    for k in range(0, 1200, 2):  # cosines from 0.93 to 0.99
        c = rng.uniform(0.93, 0.99)
        side = rng.normal(0, 1, d)
        side -= side @ x[k] / (x[k] @ x[k]) * x[k]
        x[k + 1] = c * x[k] / np.linalg.norm(x[k]) + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x[4700:] = x[4700] + rng.normal(0, 0.05, (300, d))
    x = x.astype(np.float32)
    want = pairs_near(x.astype(np.float64))
    u = forest.unit(x.astype(np.float64))
    tree = forest.Tree(u, 8, 1, forest.spill_of(0.93, d))
    row, node = tree.leaves(u, np.full(len(u), 8))
    assert (~tree.stop[1:]).sum() >= 200 and len(row) <= 5 * len(u)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in forest.near_vectors(df, leaf=16).collect()}
    assert all(got[k] <= want[k] for k in got) and want.sum() > 80_000
    assert sum(got.values()) >= 0.98 * want.sum()
    assert sum(got[k] for k in range(1200)) >= 0.95 * want[:1200].sum()
    monkeypatch.setattr(forest, "WIDE", 2)  # wide leaves are split on in their tasks
    again = {r.vec_id: r.n_links for r in forest.near_vectors(df, leaf=16, sample=300).collect()}
    assert all(again[k] <= want[k] for k in again) and sum(again[k] for k in range(1200)) >= 0.9 * want[:1200].sum()


def test_leaves_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_BYTES", 40 * 8 * 24)
    monkeypatch.setattr(forest, "BLOCK", 16)
    rows = made(3, 500, 24)
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == want


def test_chunks_are_split_on(spark, monkeypatch):
    """Two chunks that meet are split by a tree of their own: links near the bound are found, none twice, and few of all pairs are looked at."""
    looked = spark.sparkContext.accumulator(0)
    plain = forest._compare

    def counted(g, h, *rest):
        looked.add(len(g) * len(g if h is None else h))
        plain(g, h, *rest)

    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (6000, 64))
    for k in range(0, 600, 2):
        side = rng.normal(0, 1, 64)
        side -= side @ x[k] / (x[k] @ x[k]) * x[k]
        x[k + 1] = 0.96 * x[k] / np.linalg.norm(x[k]) + 0.28 * side / np.linalg.norm(side)
    x[5900:] = x[5900] + rng.normal(0, 0.05, (100, 64))
    want = pairs_near(x)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(forest, "TREE_BYTES", 4 * 8 * 64)  # the trees of all rows do not split
    monkeypatch.setattr(forest, "LEAF_BYTES", 4000 * 8 * 64)  # three chunks of some 2,000
    monkeypatch.setattr(forest, "_compare", counted)
    got = {r.vec_id: r.n_links for r in forest.near_vectors(df, leaf=32).collect()}
    assert all(got[k] <= want[k] for k in got)
    assert sum(got[k] for k in range(600)) >= 0.9 * want[:600].sum()
    assert sum(got[k] for k in range(5900, 6000)) >= 0.95 * want[5900:].sum()
    assert 0 < looked.value < 0.3 * 6000**2


def test_extreme_components(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1.0, -1.0], 1), (4, [5e-324, 1e-323], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[1] == (2, 1) and got[2] == (2, 1) and got[3] == (0, 3)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 1), (13, [-1.0, -2.0], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, cls string, leaf string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(df).collect()}
    assert got == brute(rows)
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_many_equal_and_scaled(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 64)
    rows = [(i, [1.0 + (i % 300), 2.0 * (1 + i % 300)], 1) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert all((r.n_links, r.component_id) == (899, 0) for r in forest.near_vectors(df, leaf=16).collect())


def test_op7_query(spark, sf):
    from gapwise.llm.queries import op7_embedding_dedup

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op7_embedding_dedup(spark, sf).collect()}
    assert got.keys() == want.keys() and recall(got, want) >= 0.99
