import datetime
import decimal
import sqlite3

import pytest
from pyspark.sql import functions as F

from gapwise.sources import office


def shapes(spark, n, parts=5):
    k = F.col("id")
    point = F.when(k % 10 > 0, F.struct((k / 4).alias("x"), (k % 90 * 0.5).alias("y"))).alias("wkb")
    return spark.range(0, n, 1, parts).select(k, F.when(k % 3 > 0, F.concat(F.lit("n "), k)).alias("a name"), point)


def names(path):
    return sorted(p.name for p in path.iterdir() if not p.name.endswith(".crc"))


def test_geopackages_in_parts(spark, tmp_path):
    df, to = shapes(spark, 1000), tmp_path / "a layer"
    assert office.write_gpkg_parts(df, str(to), "the layer", most=70) == 1000
    assert names(to) == [f"part-{p:05d}-{k:04d}.gpkg" for p in range(5) for k in range(3)]
    for p in to.glob("*.gpkg"):
        con = sqlite3.connect(p)
        assert con.execute('SELECT count(*) FROM "the layer"').fetchone()[0] <= 70
        assert con.execute("SELECT srs_id FROM gpkg_geometry_columns").fetchone() == (4326,)
        con.close()
    got = office.read_gpkg(spark, str(to), "the layer", "id long, `a name` string", features=9)
    want = [(r.id, r["a name"], None if r.wkb is None else (r.wkb.x, r.wkb.y)) for r in df.collect()]
    assert sorted((r.id, r["a name"], None if r.rings is None else tuple(r.rings[0][0])) for r in got.collect()) == want


def test_one_geopackage_by_ranges(spark, tmp_path):
    office.write_gpkg(shapes(spark, 500), str(tmp_path / "one.gpkg"), "w")
    got = office.read_gpkg(spark, str(tmp_path / "one.gpkg"), "w", "id long", features=20)
    tasks = got.select("id", F.spark_partition_id().alias("t")).collect()
    assert sorted(r.id for r in tasks) == list(range(500)) and len({r.t for r in tasks}) == 4


def test_types_of_attributes(spark, tmp_path):
    row = (1, decimal.Decimal("1.50"), datetime.date(2024, 2, 29), True, 2.5, 2**62 + 1, bytearray(office.point_wkb(1.0, 2.0)))
    df = spark.createDataFrame([row, (2, *[None] * 6)], "k int, m decimal(9,2), d date, b boolean, x double, n long, wkb binary")
    office.write_gpkg_parts(df, str(tmp_path / "t"), "w")
    got = office.read_gpkg(spark, str(tmp_path / "t"), "w", "k int, m string, d string, b boolean, x double, n long").drop("rings").sort("k").collect()
    assert [tuple(r) for r in got] == [(1, "1.50", "2024-02-29", True, 2.5, 2**62 + 1, row[-1]), (2, *[None] * 6)]


def test_workbooks_in_parts(spark, tmp_path):
    odd = ["", " a ", "<b> & \"c\"", "line\r\nfeed\tx", "\x00\x1b", "_x0041_", "_x_", "é 字 😀", None]
    df = spark.range(0, 90, 1, 3).select(F.col("id"), F.array(*[F.lit(x) for x in odd])[F.col("id").cast("int") % 9].alias("t"))
    assert office.write_xlsx_parts(df, str(tmp_path / "b"), most=20) == 90
    assert names(tmp_path / "b") == [f"part-{p:05d}-{k:04d}.xlsx" for p in range(3) for k in range(2)]
    got = office.read_xlsx(spark, str(tmp_path / "b"), ["id", "t"], file="book").collect()
    assert sorted((int(r.id), r.t) for r in got) == [(k, odd[k % 9]) for k in range(90)]
    assert sorted({r.row_index for r in got}) == list(range(1, 21)) and len({r.book for r in got}) == 6


def test_report_in_one_workbook(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("x", None), (None, 2)], "a string, b int").coalesce(1)
    office.write_xlsx(df, str(tmp_path / "r.xlsx"))
    assert [tuple(r) for r in office.read_xlsx(spark, str(tmp_path / "r.xlsx"), ["a", "b", "c"]).collect()] == [(1, "x", None, None), (2, None, "2", None)]
    monkeypatch.setattr(office, "EXPORT_ROWS", 1)
    with pytest.raises(ValueError):
        office.write_xlsx(df, str(tmp_path / "s.xlsx"))


def test_parts_replace_and_may_be_none(spark, tmp_path):
    to = str(tmp_path / "g")
    office.write_gpkg_parts(shapes(spark, 50), to, "w")
    office.write_gpkg_parts(shapes(spark, 10, 1), to, "w")
    assert names(tmp_path / "g") == ["part-00000-0000.gpkg"]
    assert office.read_gpkg(spark, to, "w", "id long").count() == 10
    assert office.write_gpkg_parts(shapes(spark, 0, 1), to, "w") == 0 and names(tmp_path / "g") == []
    assert office.read_gpkg(spark, to, "w", "id long").count() == 0
