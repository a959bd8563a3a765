import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P

from gapwise.llm import bpe, ids, packing

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "a  b", "a\t  b \n\n c", "x" * 3000, "don't we'll 'S", "été 中文，漢字。 　  a", "a\x1cb \x1c c\x85d", "   \n", "🙂🙂 é ½²x9", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 300_000 + " <|endoftext|>\n" + "y 1" * 100_000, "\n\n\n", "tab\tend "]
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def rows():
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab1' \n\t.é中 \x1c²_") for _ in range(rng.randrange(60))) for _ in range(300)]
    return [(i, t, "x", "y") for i, t in enumerate([None, *ODD, *mixed])] + [(None, "null id", "x", "y"), (3, "again", "x", "y")]


def test_transcode_is_tiktoken(spark):
    enc = bpe.encoding(MULTI, P.PATTERN)
    data = rows()
    got = bpe.transcode(spark.createDataFrame(data, SCHEMA), MULTI, P.PATTERN, size=7).collect()
    want = sorted((str(d), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, *_ in data)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_op4_query(spark, sf):
    from gapwise.llm.queries import op4_byte_bpe

    import base64

    import tiktoken

    with open(MULTI, "rb") as f:  # apart from the code under test
        ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in f}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_ids_are_the_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PLAIN)
    texts = [x[1] or "" for x in rows()] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    own = ids.ids(PLAIN)
    assert own.core is not None
    for x in texts:
        got = own.encode(x)
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids
        assert own.width[got].sum() == len(x.encode())


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for size in (1, 7, 16, 64):
        lengths = sorted((rng.randint(1, size) for _ in range(400)), reverse=True)
        free = []  # brute force: least room that fits
        for (window, offset), n in zip(packing.best_fit_decreasing(lengths, size), lengths):
            fit = [r for r in free if r >= n]
            assert size - offset == (min(fit) if fit else size)
            if fit:
                free.remove(min(fit))
            free.append(size - offset - n)


def check_packed(got, data, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PLAIN)
    want = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in data}
    seen, windows = {}, {}
    for r in got:
        ids = want[r.doc_id]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
        seen.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(len(x))) for d, x in want.items()}
    used = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= size
        used += at
    return used / (size * len(windows))


def test_special_token_in_a_text():
    assert ids.ids(PLAIN).encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_pack(spark, sf):
    data = [(i, t) for i, (_, t, *_) in enumerate(rows())] + [(9999, "long text " * 700)]
    got = packing.pack_documents(spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, length string, offset int"), PLAIN, 64).collect()
    check_packed(got, data, 64)
    empty = packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PLAIN)
    assert empty.count() == 0


def test_op8_query(spark, sf):
    from gapwise.llm.queries import op8_packing

    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packed(op8_packing(spark, sf).collect(), data, 1024) > 0.9
