"""Files of which each block is read by a task of its own."""

import csv
import io
import json
import random

import pytest

from gapwise.sources import delimited, geojson, splits


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "701", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_quoted_line_feeds_over_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(['a', '"', '\n', ',', ' ', 'é', '""', '\n\n', 'b']) for _ in range(rng.randrange(40)))
    rows = [[str(k), text() or "x", str(k * 2)] for k in range(300)] + [["300", "long " * 400 + '\n"' + "y\n" * 300, "600"], ["301", "end", "602"]]
    for newline in ("\n", "\r\n"):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=newline).writerows(rows)
        (tmp_path / "a.csv").write_bytes(out.getvalue().encode("latin-1"))
        assert spark.read.text(str(tmp_path / "a.csv"), lineSep="\n").rdd.getNumPartitions() > 10
        got = delimited.read_headless(spark, str(tmp_path / "a.csv"), "k int, t string, n int").collect()
        assert sorted((r.row_index, r.k, r.t, r.n) for r in got) == [(k, k, r[1], 2 * k) for k, r in enumerate(rows)]


def test_blank_lines_keep_their_place(spark, tmp_path, small_blocks):
    (tmp_path / "a.mid").write_text("1,a\n\n  \n2,b\n3,c")
    (tmp_path / "e.mid").write_text("")
    read = lambda f: sorted(map(tuple, delimited.read_headless(spark, str(tmp_path / f), "k int, t string").collect()))
    assert read("a.mid") == [(0, 1, "a"), (3, 2, "b"), (4, 3, "c")] and read("e.mid") == []


def test_points_by_place(spark, tmp_path, small_blocks):
    lines = ["Version 300", "Data"] + [x for k in range(500) for x in (f"Point {k}.5 {k}.25", "    Symbol (34,0,12)")]
    (tmp_path / "a.mif").write_text("\n".join(lines))
    got = delimited.read_mif_points(spark, str(tmp_path / "a.mif")).collect()
    assert sorted(map(tuple, got)) == [(k, k + 0.5, k + 0.25) for k in range(500)]


def features(n, rng):
    odd = ["}", "{", '"', "\\", '\\"}', "é{}", "", "]}", "\n"]
    out = []
    for k in range(n):
        name = "".join(rng.choice(odd) for _ in range(rng.randrange(8)))
        more = {"deep": {"a": {"b": [{"c": name}]}}} if k % 3 == 0 else {}
        g = {"type": "LineString", "coordinates": [[k * 0.5, 1.0], [k + 0.25, 2.0]]} if k % 5 else {"type": "Point", "coordinates": [k, 1.0]}
        out.append({"type": "Feature", "properties": {"k": k, "name": name, **more}, "geometry": g})
    return out


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("front", [True, False])
def test_one_geojson_in_many_blocks(spark, tmp_path, small_blocks, indent, front):
    made = features(150, random.Random(3))
    crs = {"crs": {"type": "name", "properties": {"name": "urn:{x}"}}, "note": 'a "{" b'}
    doc = {"type": "FeatureCollection", **(crs if front else {}), "features": made, **({} if front else crs)}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    assert splits.pieces(spark, str(tmp_path / "a.json"), "}").rdd.getNumPartitions() > 10
    got = geojson.read_geojson(spark, str(tmp_path / "a.json"), "k int, name string").collect()
    want = [(k, k, f["properties"]["name"], f["geometry"]["coordinates"]) for k, f in enumerate(made) if f["geometry"]["type"] == "LineString"]
    assert sorted((r.ord, r.k, r.name, [[p.x, p.y] for p in r.points]) for r in got) == want


def test_no_features(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert geojson.read_geojson(spark, str(tmp_path / "a.json"), "k int").count() == 0


def test_ordered_export_to_one_file(spark, tmp_path):
    rows = [(k * 37 % 1000, f'a "q" {k}\nx') for k in range(1000)] + [(None, "last")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(7)
    to = str(tmp_path / "out.csv")
    delimited.write_csv(df, to, one_file=True, order=["-k"], escape='"', quoteAll=True)
    with open(to, newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["k", "t"] and [int(x[0]) for x in got[1:1001]] == list(range(999, -1, -1)) and got[1001] == ["", "last"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["out.csv"]


def test_no_block_is_one_group(spark, tmp_path):
    """One block of a file is many groups, which rise in the order of the file."""
    (tmp_path / "a.txt").write_text("".join(f"{k}\n" for k in range(50_000)))
    x = splits.pieces(spark, str(tmp_path / "a.txt"))
    assert max(r["count"] for r in x.groupBy(*splits.BLOCK).count().collect()) <= 1 << 14
    assert splits.numbered(x).where("row_index <> cast(text as long)").isEmpty()
