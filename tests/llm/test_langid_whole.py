import math

import pytest

from gapwise.llm import langid
from gapwise.llm.queries import op2_language_id


def letters(text):
    """Lower case, each run of anything but letters as one space, none in front."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


class Sample:
    """Whether a string is part of a sample: short ones from a set, longer ones by search."""

    def __init__(self, text, short=14):
        self.text, self.short = text, short
        self.parts = {text[i : i + k] for k in range(1, short + 1) for i in range(len(text) - k + 1)}

    def phrases(self, text):
        n = at = 0
        while at < len(text):
            k = 1
            while at + k <= len(text) and (text[at : at + k] in self.parts if k <= self.short else text[at : at + k] in self.text):
                k += 1
            at += max(1, k - 1)
            n += 1
        return n


def test_op2_whole_result(spark, sf):
    """The query against a plain parse of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = langid.learn(langid.training_rows(docs))
    plain = {x: Sample(t) for x, t in samples.items()}
    bits = {x: math.log2(max(2, len(t))) for x, t in samples.items()}
    want = {}
    for r in docs.select("doc_id", "text").collect():
        text = letters(r.text or "")
        if not text.strip():
            want[r.doc_id] = ("und", 0.0)
            continue
        parts = [text[i : i + langid.SEGMENT] for i in range(0, len(text), langid.SEGMENT)]
        rates = sorted((sum(map(plain[x].phrases, parts)) * bits[x] / len(text), x) for x in plain)
        want[r.doc_id] = (rates[0][1], (rates[1][0] - rates[0][0]) / rates[1][0])
    got = {r.doc_id: (r.lang_pred, r.score) for r in op2_language_id(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, (lang, score) in want.items():
        assert got[k] == (lang, pytest.approx(score, abs=1e-9))
