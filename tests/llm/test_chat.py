import hashlib
import random

from gapwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
HARD = r"\### Assistant: </turn> ok"


def brute(rows):
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a: b", "# <"]), rng.choice([None, "", HARD, "### x: y </turn>\n", "\\", "\\\\:", "é🙂\n", "plain"]), "z") for c in [None, *range(60)] for t in [None, *range(rng.randrange(6))]]
    rows += rows[:7] + [(99, i, "assistant", "x" * 5000, "z") for i in range(300)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # conversations run over batches
    try:
        df = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(df).collect()}
        assert df.count() == len(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_marks_stand_only_between_turns(spark):
    df = chat.format_conversations(spark.createDataFrame([(1, 0, "user", HARD, ""), (1, 1, "assistant", HARD, "")], SCHEMA))
    x = bytes(df.first().formatted)
    assert x.count(b"### ") == 2 and x.count(b"</turn>") == 2
    assert chat.parse(x) == [("user", HARD), ("assistant", HARD)]


def test_empty(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_op10_query(spark, sf):
    from gapwise.llm.queries import op10_chat_format

    rows = [(*r, "") for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD, ""), (-7, 1, "assistant", HARD, "")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_chat_format(spark, sf).collect()}
    assert got == brute(rows)
