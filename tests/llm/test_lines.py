import random
import re

from gapwise.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]")


def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, least):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        all_lines, keep = (t or "").split("\n"), []
        for x in all_lines:
            if not WORD.search(x):
                keep.append(x)
                continue
            if not any(x == y or (min(len(x), len(y)) >= least and within_one(x, y)) for y in seen):
                keep.append(x)
            seen.append(x)
        out[i] = (len(all_lines), len(all_lines) - len(keep), "\n".join(keep))
    return out


def edited(rng, x):
    k, c = rng.randrange(len(x) + 1), rng.choice("abé 1")
    return rng.choice([x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :], x])


def made(seed, sizes):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.choice(sizes))) for _ in range(40)] + ["", " ", "\t", "short"]
    rows = []
    for i in range(60):
        x = []
        for _ in range(rng.randrange(1, 9)):
            y = rng.choice(pool)
            if y.strip():
                for _ in range(rng.randrange(3)):
                    y = edited(rng, y)
                pool.append(y)
            x.append(y)
        rows.append((i, "\n".join(x)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, rows[0][1])]
    rng.shuffle(rows)
    return rows


def check(spark, rows, least):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, line string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.dedup_lines(df, least).collect()}
    assert got == brute(rows, least)


def test_against_brute_force(spark):
    check(spark, made(1, [3, 19, 20, 21, 22, 31, 32, 33]), 20)
    check(spark, made(2, [40, 63, 64, 65, 66, 128, 129, 200, 511, 512]), 20)
    check(spark, made(3, [1000, 1023, 1024, 3000, 20000]), 20)


def test_short_least(spark):
    check(spark, made(4, [1, 2, 3, 4, 5, 6, 7]), 2)


def test_repeated_rows(spark):
    rows = [(1, "the very same line of text\nand more")] * 2 + [(2, "the very same line of text")]
    got = sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 1)]
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op5_query(spark, sf):
    from gapwise.llm.queries import op5_line_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    import hashlib

    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute(rows, 20).items()}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in op5_line_dedup(spark, sf).collect()} == want


def test_very_long_lines(spark):
    rng = random.Random(11)
    a = "".join(rng.choice("abcdé ") for _ in range(700_000))
    k = 433_333
    rows = [(1, a), (2, a[:k] + a[k + 1 :]), (3, a[:k] + "z" + a[k:]), (4, "z" + a[1:-1] + "z"), (5, a[:k] + "z" + a[k + 1 :] + "\nq"), (6, a[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(df).collect()) == [(1, 0), (2, 1), (3, 1), (4, 0), (5, 1), (6, 0)]


def test_long_lines_that_share_a_half(spark):
    rng = random.Random(12)
    half = "".join(rng.choice("abcd ") for _ in range(1500))
    rows = [(i, half + "".join(rng.choice("abcd ") for _ in range(1500))) for i in range(60)]
    rows += [(100 + i, edited(rng, t)) for i, t in rows[:30]]
    check(spark, rows, 20)
