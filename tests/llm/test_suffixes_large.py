import numpy as np

from gapwise.llm import suffixes

LENGTH = 100


def contexts(left, right):
    n = len(left)
    at = np.full(n, LENGTH - suffixes.GRAM)  # passages that end with the anchor's gram
    return suffixes.Contexts(right, left, np.full(n, LENGTH), at, at, at)


def test_left_sides_stay_apart_when_the_index_does_not_fit():
    n = 1 << 21
    left = np.full((n, LENGTH - suffixes.GRAM), 97, np.uint8)
    for k in range(3):
        left[:, k] = 98 + (np.arange(n) >> 7 * (2 - k) & 127)
    left[n - 1] = left[5]
    least, most, _ = suffixes.repeats(contexts(left, np.full((n, LENGTH), 97, np.uint8)), LENGTH)
    assert np.flatnonzero(most >= 0).tolist() == [n - 1]
    assert least[n - 1] == most[n - 1] == LENGTH - suffixes.GRAM


def test_rows_touched_grow_as_n_log_n():
    rng = np.random.default_rng(1)
    batch, touched, found = 500, {}, 0
    family, n = suffixes.Family(LENGTH), 0
    old = None
    for _ in range(64):
        left, right = rng.integers(97, 101, (batch, LENGTH - suffixes.GRAM), dtype=np.uint8), rng.integers(97, 101, (batch, LENGTH), dtype=np.uint8)
        if old is not None:
            left[:50], right[:50] = old
        old = left[50:100].copy(), right[50:100].copy()
        least, most = family.add(contexts(left, right))
        found += int((most >= 0).sum())
        assert (most[50:] == -1).all()
        n += batch
        touched[n] = family.touched
    assert found == 63 * 50
    assert [len(level) for _, level in family.levels] == [n]
    for k in (4000, 8000, 16000):
        assert touched[2 * k] <= 2.5 * touched[k] * np.log2(4 * k / batch) / np.log2(2 * k / batch)
        assert touched[k] <= 2 * k * np.log2(k / batch) + 2 * k
    level = family.levels[0][1]
    assert (level.right[1:] >= level.right[:-1]).all() and (level.left[1:] >= level.left[:-1]).all()
    assert sorted(level.across.tolist()) == list(range(n))
