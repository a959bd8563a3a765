import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gapwise.llm import counts

PLAIN = P.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PLAIN)


def brute(text, rule):
    """Sections and tokens byte by byte, with the library's own tokens."""
    raw = (text or "").encode()
    lines = [x for x in re.split(rb"(?<=\n)", raw) if x] or [b""]
    owner = [i for i, x in enumerate(lines) for _ in x]
    n, cross, at = [0] * len(lines), [0] * len(lines), 0
    for token in LIBRARY.encode(text or "", add_special_tokens=False).tokens:
        own = owner[at : at + len(token)]
        at += len(token)
        s = own[0] if rule == "start" else own[-1] if rule == "end" else max(sorted(set(own)), key=own.count)
        n[s] += 1
        cross[s] += own[0] != own[-1]
    ends = np.cumsum([len(x) for x in lines])
    chars = [len(raw[:e].decode()) for e in ends]
    return [(i, a, b, x, y) for i, (a, b, x, y) in enumerate(zip([0, *chars[:-1]], chars, n, cross))]


@pytest.mark.parametrize("rule", counts.RULES)
def test_against_brute_force(spark, rule):
    rng = random.Random(7)
    texts = [None, "", "\n", "\n\n\n", "a\n\n\n  b", "é🙂\n中文 \n\n x", "one line", "line\nline\n", " \n \n\n \n"]
    texts += ["".join(rng.choice("ab \n\né") for _ in range(rng.randrange(80))) for _ in range(150)] + ["word \n\n" * 5000, "a <|endoftext|>\n<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    got = {}
    for r in counts.section_counts(df, PLAIN, rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got == {i: brute(t, rule) for i, t in enumerate(texts)}


def test_empty(spark):
    assert counts.section_counts(spark.createDataFrame([], "doc_id long, text string"), PLAIN).count() == 0
    with pytest.raises(ValueError):
        counts.section_counts(spark.createDataFrame([], "doc_id long, text string"), PLAIN, "split")


def test_op6_query(spark, sf):
    from gapwise.llm.queries import op6_token_counts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in op6_token_counts(spark, sf).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got.keys() == docs.keys()
    assert [i for i in docs if got[i] != brute(docs[i], "start")] == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b\nc"), (1, "a b\nc"), (None, "x"), (None, None)]
    got = sorted(map(str, map(tuple, counts.section_counts(spark.createDataFrame(rows, "doc_id long, text string"), PLAIN).collect())))
    assert got == sorted(str((i, *x)) for i, t in rows for x in brute(t, "start"))
