import math

from pyspark.sql import functions as F

from gapwise.plans import metrics
from gapwise.sources import bucketed, typed

HEAD = "whole,gaps,real,truth,mixed,wide,big,none,text,signs,code"
ROWS = [
    '1,NA,1.5,True,True,1,99999999999999999999,,a,+1,007',
    '-2,3,2,FALSE,1,99999999999999999999,12,NULL,"1,5",-.5,008',
    '9223372036854775807,,1e3,true,x,2.5,3,n/a,NaN,5.,009',
]


def put(tmp_path, rows, name="a.csv"):
    (tmp_path / name).write_text("\n".join([HEAD, *rows]) + "\n", encoding="utf-8")
    return str(tmp_path / name)


def test_types_come_from_all_rows(spark, tmp_path):
    df = typed.read_typed_csv(spark, put(tmp_path, ROWS), text=("code",))
    assert dict(df.dtypes) == {"whole": "bigint", "gaps": "bigint", "real": "double", "truth": "boolean", "mixed": "string", "wide": "double", "big": "string", "none": "double", "text": "string", "signs": "double", "code": "string"}
    got = df.collect()
    assert [r.whole for r in got] == [1, -2, 2**63 - 1] and [r.gaps for r in got] == [None, 3, None]
    assert [r.real for r in got] == [1.5, 2.0, 1000.0] and [r.truth for r in got] == [True, False, True]
    assert [r.big for r in got] == ["99999999999999999999", "12", "3"] and [r.none for r in got] == [None] * 3
    assert [r.text for r in got] == ["a", "1,5", None] and [r.signs for r in got] == [1.0, -0.5, 5.0] and [r.code for r in got] == ["007", "008", "009"]


def test_one_late_row_decides(spark):
    texts = spark.range(5000, numPartitions=8).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") == 4321, "x").otherwise("1").alias("b"), F.when(F.col("id") == 17, "inf").otherwise("1").alias("c"))
    types = typed.infer_types(texts)
    assert types == {"a": "bigint", "b": "string", "c": "double"}
    assert math.isinf(typed.typed(texts, types).agg(F.max("c")).first()[0])


def test_no_rows_and_odd_names(spark, tmp_path):
    assert set(dict(typed.read_typed_csv(spark, put(tmp_path, [])).dtypes).values()) == {"string"}
    texts = spark.createDataFrame([("1", "2")], "`a.b` string, `c d` string")
    assert typed.typed(texts, typed.infer_types(texts)).collect() == [(1, 2)]
    assert typed.infer_types(texts, ("a.b", "c d")) == {"a.b": "string", "c d": "string"}


def test_relation_in_sql(spark, tmp_path):
    typed.csv_relation(spark, "typed_relation", put(tmp_path, ROWS))
    assert spark.sql("SELECT sum(gaps) AS s FROM typed_relation WHERE truth AND real > 1 OR gaps = 3").first().s == 3
    typed.csv_relation(spark, "text_relation", put(tmp_path, ROWS), typed=False)
    assert set(dict(spark.table("text_relation").dtypes).values()) == {"string"}


def test_bucketed_joins_move_no_rows(spark, tmp_path):
    a = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("a"))
    b = spark.range(900).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("k"), F.col("id").alias("b"))
    for n, name in ((4, "x"), (8, "y")):
        bucketed.write_bucketed(a, f"bucketed_a_{name}", ["k"], n, str(tmp_path / f"a{name}"))
        t = bucketed.write_bucketed(b, f"bucketed_b_{name}", ["k"], n, str(tmp_path / f"b{name}"))
        assert t.count() == 900
        joined = spark.table(f"bucketed_a_{name}").join(t.hint("merge"), "k").groupBy("k").agg(F.count("*").alias("n"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "k").groupBy("k").count().collect()))
    again = bucketed.write_bucketed(b.limit(5), "bucketed_b_x", ["k"], 4, str(tmp_path / "bx"))
    assert again.count() == 5


def test_metrics_of_stages(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), F.when(F.col("id") % 10 > 0, F.col("id") / 2).alias("v"))
    stages = [
        ("odd", lambda x: x.where("id % 2 = 1"), {}),
        ("twice", lambda x: x.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(2)))), metrics.spread("v") | {"sum": F.sum("v")}),
        ("groups", lambda x: x.groupBy((F.col("id") % 5).alias("g")).agg(F.max("v").alias("m")), metrics.shares("g", ["1", "9"])),
        ("none", lambda x: x.where("g > 99"), metrics.spread("m")),
    ]
    out, found = metrics.run_stages(df, stages, str(tmp_path / "stages"))
    got = {(r.stage, r.metric): r.value for r in found.collect()}
    assert out.count() == 0
    for stage, *want in (("odd", 1000, 500, 500), ("twice", 500, 1000, -500), ("groups", 1000, 5, 995), ("none", 5, 0, 5)):
        assert [got[stage, f"rows_{k}"] for k in ("in", "out", "dropped")] == want
    odd = range(1, 1000, 2)
    assert (got["twice", "v_missing"], got["twice", "v_least"], got["twice", "v_most"], got["twice", "sum"]) == (0, 0.5, 499.5, sum(odd))
    assert got["groups", "g_1"] == 1 and got["groups", "g_9"] == 0 and got["none", "m_most"] is None and got["none", "m_missing"] == 0


def test_metrics_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long")
    _, found = metrics.run_stages(none, [("all", lambda x: x, {"n": F.count("id")}), ("more", lambda x: x.where("id > 1"), {})], str(tmp_path / "s"))
    assert {(r.stage, r.metric, r.value) for r in found.collect()} == {("all", m, 0.0) for m in ("rows_in", "rows_out", "rows_dropped", "n")} | {("more", m, 0.0) for m in ("rows_in", "rows_out", "rows_dropped")}
