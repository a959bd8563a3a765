import random
import re
from collections import Counter

import pytest

from gapwise.llm import phrases as P


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, longest, least, percent, most):
    f = {}
    for lang, text in rows:
        c = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for n in range(1, longest + 1):
                c.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        total = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        inside = {}
        for p, v in cand.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    q = p[i : i + n]
                    inside[q] = max(inside.get(q, 0), v)
        found = []
        for p, a in cand.items():
            if 100 * inside.get(p, 0) >= percent * a:
                continue
            score, _, le, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), le, r))
        out += [(lang, k + 1, p.decode(), -a, le, r, total, -s) for k, (s, a, p, le, r) in enumerate(sorted(found)[:most])]
    return out


def made(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "é", "É", "x\x0bx", "a\x1fb", "-", "n°", "日本"] + [f"w{k}" for k in range(25)]
    fixed = ["new york city", "per se", "w1 w1 w1 w1", "in spite of"]
    text = lambda: "".join(rng.choice(words + fixed) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "fr", None, "und", ""]), text()) for _ in range(n)] + [("en", None), (None, ""), ("de", "..."), ("sv", "word")]


def check(spark, rows, longest=3, least=10, percent=50, most=2000, **options):
    docs = spark.createDataFrame([(k, t, la, "x", 1) for k, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long").repartition(3)
    got = [tuple(r) for r in P.collocations(docs, longest, least, percent, most, bits=options.pop("bits", 18), **options).collect()]
    assert sorted(got) == sorted(brute(rows, longest, least, percent, most))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_against_brute_force(spark, longest):
    check(spark, made(longest), longest)


def test_full_buckets_lose_and_add_nothing(spark):
    check(spark, made(7), bits=16, least=3)
    check(spark, made(8), most=7)


def test_cut_texts_count_every_phrase_once(spark):
    rows = made(9, 60) + [("en", "new york city hall " * 400), ("en", "w1 " * 500 + ". " + "w2 w3\n" * 300)]
    check(spark, rows, size=64)
    check(spark, rows, size=700)


def test_thresholds(spark):
    nine, ten = ("en", "a b. " * 9), ("fr", "a b. " * 10)
    half = ("de", "c d e. " * 10 + "c d. " * 10)  # c d: 20, inside c d e with 50 %
    less = ("sv", "c d e. " * 10 + "c d. " * 11)
    check(spark, [nine, ten, half, less])


def test_counts_over_255(spark):
    check(spark, [("en", "a b c " * 2000)], least=300)


def test_nothing(spark):
    check(spark, [])
    check(spark, [("en", None), (None, "  ")])


def test_very_long_texts(spark):
    rows = [("en", "x" * 3_000_000), ("en", "new york city " * 300_000), ("en", " " * 3_000_000)]
    check(spark, rows, size=1 << 20)


def test_scores_past_64_bits(spark):
    x = spark.sql("SELECT CAST(3000000000000 AS BIGINT) AS a, CAST(5000000000000 AS BIGINT) AS l, CAST(4000000000001 AS BIGINT) AS r")
    assert x.select(P.score()).first()[0] == 10**6 * 3000000000000**2 // (5000000000000 * 4000000000001)
