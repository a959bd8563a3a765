import hashlib
import random

import numpy as np
import pytest

from gapwise.llm import suffixes


def brute(rows, length=100):
    """id -> (n, starts, ends, kept), with a set of all passages so far."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            x = raw[k : k + length]
            if x in seen:
                gone[k : k + length] = True
            seen.add(x)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out[i] = (len(raw), edge[::2].tolist(), edge[1::2].tolist(), bytes(b for b, g in zip(raw, gone) if not g))
    return out


def texts_of(rows, length=100):
    """id -> the characters of which no byte goes."""
    out, texts = {}, dict(rows)
    for i, (n, starts, ends, _) in brute(rows, length).items():
        gone = np.zeros(n + 1, bool)
        for a, b in zip(starts, ends):
            gone[a:b] = True
        at, kept = 0, []
        for c in texts[i] or "":
            k = len(c.encode())
            if not gone[at : at + k].any():
                kept.append(c)
            at += k
        out[i] = "".join(kept)
    return out


def made(seed, alphabet):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [say(rng.randrange(60, 400)) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 99), (4, "x" * 100), (5, "x" * 700), (6, "ab" * 300), (7, "\0" * 150), (8, "y\0" * 40 + "\0" * 60)]
    for i in range(10, 110):
        parts = []
        for _ in range(rng.randrange(6)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [say(rng.randrange(150)), s[a : rng.randrange(a, len(s)) + 1] if rng.random() < 0.5 else s]
        rows.append((i, "".join(parts)))
    rows += [(200, rows[20][1]), (201, rows[20][1] + "z"), (None, rows[30][1] + rows[31][1])]
    rng.shuffle(rows)
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, pos int")
    got = {r.doc_id: (r.n_bytes, r.starts, r.ends, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, made(1, "abcdefghij é"))
    check(spark, made(2, "ab"))


def test_levels_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 7)
    monkeypatch.setattr(suffixes, "UNIT", 40)
    check(spark, made(3, "abcdefgh "))
    monkeypatch.setattr(suffixes, "HOT", 3)
    check(spark, made(4, "abcdefgh "))
    check(spark, made(5, "ab"))
    monkeypatch.setattr(suffixes, "TOP", 2)  # some passages from the broadcast, the others dealt
    check(spark, made(5, "ab"))


def test_cut_characters_go_whole(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("aé中🙂") for _ in range(90)).encode()
    # the same bytes of a character behind different first bytes, and the other way round
    rows = [(1, "x" + shared.decode() + "é"), (2, "é" + shared.decode() + "è"), (3, "ĩ" + shared.decode()), (4, "中" * 120), (5, "丮" + "中" * 60 + "丽")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = texts_of(rows)
    assert {r.doc_id: r.text for r in suffixes.kept_texts(df).collect()} == want


def test_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    check(spark, [(1, long), (2, "q" + long[5000:9000] + "q"), (3, long[::-1])])


def test_repeated_rows(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.kept)) for r in suffixes.remove_repeats(df).collect()) == [(1, 300), (1, 300), (2, 0)]
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(df, 50)


def test_every_passage_has_an_anchor():
    rng = np.random.default_rng(1)
    raw = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    text, pos, key = suffixes.anchors([raw[:2000], b"", raw[2000:]], 100)
    for t, n in ((0, 2000), (2, 3000)):
        p = pos[text == t]
        assert all(((p >= s) & (p <= s + 100 - suffixes.GRAM)).any() for s in range(n - 99))


def test_op3_query(spark, sf):
    from gapwise.llm.queries import op3_suffix_array_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, (n, s, _, k) in brute(rows).items()}
    assert {r.doc_id: tuple(r)[1:] for r in op3_suffix_array_dedup(spark, sf).collect()} == want
