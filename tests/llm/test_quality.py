import random
import re

import numpy as np

from gapwise.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, window=5):
    words = WORD.findall(text or "")
    grams = {}
    for i in range(len(words) - window + 1):
        grams.setdefault(tuple(words[i : i + window]), []).append(i)
    inside = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + window)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def verdict(text):
    """(covered_words, longest_repeat, kept) from windows of words that occur twice."""
    words, k = WORD.findall(text or ""), 0
    while True:
        seen = [tuple(words[i : i + k + 1]) for i in range(len(words) - k)]
        if len(set(seen)) == len(seen):
            break
        k += 1
    n, *_, repeated = brute(text)
    cover = brute(text, 10)[4]
    return cover, k, n >= 10 and 100 * repeated <= 20 * n and 100 * cover <= 15 * n and k <= 50


def test_repeats_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        words = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(40))]
        got = Q.repeat_lengths(np.array(words, np.int64))
        want = [max((k for j in range(len(words)) if j != i for k in range(len(words) - max(i, j) + 1) if words[i : i + k] == words[j : j + k]), default=0) for i in range(len(words))]
        assert got.tolist() == want


TEXTS = [None, "", " \n\t", "a\nb\na\n a\n\na", "one two three four five six seven eight nine ten", "x y z v w " * 9, "é è ü ñ # $ <|>", "p " * 800, "\n".join(["the same line of seven words here"] * 3), " ".join(str(i) for i in range(20000))]


def test_edges(spark):
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert (r.covered_words, r.longest_repeat, r.kept) == verdict(t)
    assert got[4].kept and got[9].kept and not got[7].kept
    assert Q.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_repeat_fails(spark):
    part = " ".join(f"w{i}" for i in range(60))
    rest = " ".join(f"v{i}" for i in range(900))
    r = Q.quality(spark.createDataFrame([(1, f"{part} {rest} {part}")], "doc_id long, text string")).first()
    assert not r.base_failed and r.longest_repeat == 60 and r.covered_words == 120 and not r.kept


def test_op9_query(spark, sf):
    from gapwise.llm.queries import op9_quality_rules

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])
        assert (r.covered_words, r.longest_repeat, r.kept) == verdict(docs[r.doc_id]), r.doc_id


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, TEXTS[4]), (1, TEXTS[4]), (None, TEXTS[4]), (None, None)]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == [("1", 10, True), ("1", 10, True), ("None", 0, False), ("None", 10, True)]
