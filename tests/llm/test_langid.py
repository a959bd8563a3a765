import random
import zlib

import numpy as np
import pytest

from gapwise.llm import langid


def brute(sample, text):
    """Phrases of the greedy parse of ``text`` into longest substrings of ``sample``."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) + 1 and text[at : at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_brute_force():
    rng = random.Random(1)
    samples = {x: "".join(rng.choice("abcd ") for _ in range(400)) for x in ("p", "q")}
    samples["r"] = "ab"
    p = langid.Parser(samples)
    texts = ["".join(rng.choice("abcdz ") for _ in range(rng.randrange(1, 200))) for _ in range(60)] + ["", "a" * 3000]
    got = p.phrases([p.codes(" ".join(t.split()))[0] if t else np.zeros(0, np.uint8) for t in texts])
    for t, row in zip(texts, got):
        t = " ".join(t.split())
        parts = [t[i : i + langid.SEGMENT] for i in range(0, len(t), langid.SEGMENT)] if any(c != " " for c in t) else []
        assert row.tolist() == [sum(brute(samples[x], s) for s in parts) for x in p.langs]


def test_every_letter_is_apart():
    rng = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(700)] + list("abcdé")
    samples = {x: "".join(rng.choice(letters[k * 200 : k * 200 + 400] + [" "]) for _ in range(900)) for k, x in enumerate(("p", "q"))}
    samples["r"] = "abab abba"
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(6):
            own = samples[rng.choice("pqr")]
            a = rng.randrange(len(own))
            parts += [own[a : a + rng.randrange(12)], rng.choice([*letters, "ж"])]
        texts.append(" ".join("".join(parts).split()))
    for dense in (0, 1 << 27):
        p = langid.Parser(samples, dense)
        assert (len(p.keys) > 0) == (dense == 0)
        got = p.phrases([p.codes(t)[0] for t in texts])
        assert got.tolist() == [[brute(samples[x], t) for x in p.langs] for t in texts]


def test_sample_is_bounded(spark):
    rows = [(None, "many copies of one text", "en")] * 300 + [(k, f"text {k}", f"l{k % 9}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(docs, max_langs=4)
    assert len(samples) == 4 and samples["en"] == "many copies of one text"
    assert all(len(x) <= 100 for x in langid.learn(docs, train_chars=100).values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 9, "en", "s"), (2, "der hund und die katze " * 9, "de", "s"), (None, "x", None, "s"), (4, None, "en", "s")], "doc_id long, text string, lang string, score string")
    samples = langid.learn(docs)
    assert set(samples) == {"en", "de"}
    asked = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 -- \n", 0), (None, "The DOG", 0), (4, "Die Katze! " * 20000, 0), (4, "日本語", 0)], "doc_id long, text string, lang_pred int")
    got = [(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in langid.identify(asked, samples).collect()]
    assert got[:5] == [(1, "und", True), (2, "und", True), (3, "und", True), (None, "en", True), (4, "de", True)]
    assert got[5][1] in ("en", "de")
    assert langid.identify(asked, {}).where("lang_pred = 'und'").count() == 6
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(empty) == {} and langid.identify(empty, samples).count() == 0


def test_op2_held_out_accuracy(spark, sf):
    from gapwise.llm.queries import op2_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
