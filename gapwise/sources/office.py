"""Spreadsheets and GeoPackage files: folders of many files, written and read by many tasks.

A dataset is a folder whose files each task writes by itself, none above a bound
of rows, and which tasks read file by file; the features of one GeoPackage on a
mounted file system are read by ranges of their row numbers. A worksheet cannot
be split, but its format ends it at 1,048,576 rows. Reports in one file go
through the driver, up to ``EXPORT_ROWS``.
"""

from __future__ import annotations

import datetime
import decimal
import io
import os
import re
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import ship

#: Rows that a task turns into one Arrow batch, and features that it reads at most.
BATCH, FEATURES = 10_000, 250_000
#: Rows of a worksheet, by its format, and of a part's GeoPackage.
SHEET_ROWS, LAYER_ROWS = 1_048_576, 1_000_000

# The namespaces of a workbook's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


#: What a workbook's texts write as _xHHHH_: what XML cannot hold or would change, and what would look like such a code.
_UNSAFE, _CODE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)"), re.compile("_x([0-9A-Fa-f]{4})_")


def _coded(text: str) -> str:
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _decoded(text: str) -> str:
    return _CODE.sub(lambda m: chr(int(m[1], 16)), text)


def sheet_rows(file, sheet: int = 0) -> Iterator[list[str | None]]:
    """Cells of a sheet as texts, row by row up to the last cell of each; holds the workbook's shared texts and one row."""
    z = zipfile.ZipFile(file)
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    target = links[book.find(f"{MAIN}sheets")[sheet].get(LINK)]
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [_decoded("".join(t.text or "" for t in s.iter(f"{MAIN}t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as data:
        steps = ElementTree.iterparse(data, ("start", "end"))
        held = None
        for event, row in steps:
            if event == "start" and row.tag == f"{MAIN}sheetData":
                held = row
            if event == "start" or row.tag != f"{MAIN}row":
                continue
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{MAIN}c")):
                value = c.find(f"{MAIN}v")
                text = _decoded("".join(t.text or "" for t in c.iter(f"{MAIN}t"))) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells[_column(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            if held is not None:
                held.clear()


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(files of a folder or path as path, content; whether tasks open them by path and content is null)."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = spark.read.format("binaryFile").load(path)
    if fs.getUri().getScheme() == "file":
        return files.select("path", F.lit(None).cast("binary").alias("content")), True
    return files.select("path", "content"), False


def _local(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def read_xlsx(spark: SparkSession, path: str, names: list[str], sheet: int = 0, header: int = 1, file: str | None = None) -> DataFrame:
    """Rows of a sheet as text columns, named by position, with row_index; the first ``header`` rows are left out.

    ``path`` is a workbook or a folder of them; each is read by one task, which
    streams its rows. row_index is the place in its own workbook; with several,
    ``file`` names a column for the workbook's path.
    """
    ship(spark)
    columns = ["row_index", *names, *([file] if file else [])]
    schema = ", ".join(["row_index long", *(f"`{n}` string" for n in columns[1:])])
    shape = pa.schema([("row_index", pa.int64()), *((n, pa.string()) for n in columns[1:])])

    def run(batches):
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1)):
                part = []
                for i, r in enumerate(sheet_rows(_local(at) if not raw.is_valid else io.BytesIO(raw.as_py()), sheet)):
                    if i >= header:
                        part.append((i, *(r + [None] * len(names))[: len(names)], *([at] if file else [])))
                    if len(part) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), shape)], schema=shape)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), shape)], schema=shape)

    return _files(spark, path)[0].mapInArrow(run, schema)


class Workbook:
    """A workbook with one sheet of inline texts, written row by row."""

    def __init__(self, file, columns: list[str]):
        m = MAIN.strip("{}")
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        self.data = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.data.write(f'<worksheet xmlns="{m}"><sheetData>'.encode())
        self.add([columns])

    def add(self, rows) -> None:
        cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{_coded(str(v))}</t></is></c>'
        self.data.write("".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows).encode())

    def close(self) -> None:
        self.data.write(b"</sheetData></worksheet>")
        self.data.close()
        self.zip.close()


# -- GeoPackage ---------------------------------------------------------------

# Sizes of the bounding box by the header's envelope code.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def wkb_of(blob: bytes) -> bytes:
    """The WKB after a GeoPackage header."""
    return blob[8 + ENVELOPE[(blob[3] >> 1) & 7] :]


def gpkg_blob(wkb: bytes, srs: int = 4326) -> bytes:
    return b"GP\x00\x01" + struct.pack("<i", srs) + wkb


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def rings_of(wkb: bytes) -> list[list[tuple[float, float]]]:
    """Point lists of a point, line, polygon or a collection of them, little or big endian; Z and M values are left out."""

    def one(at: int) -> tuple[list, int]:
        e = "<" if wkb[at] else ">"
        code, at = struct.unpack_from(f"{e}I", wkb, at + 1)[0], at + 5
        # further values a point: 1000s for Z, M and both, or the two high bits of the older form
        more = ((code & 0x0FFFFFFF) // 1000 + 1) // 2 + (code >> 31) + (code >> 30 & 1)
        kind, step = (code & 0x0FFFFFFF) % 1000, 8 * (2 + more)
        line = lambda at, n: ([struct.unpack_from(f"{e}dd", wkb, at + step * i) for i in range(n)], at + step * n)
        if kind == 1:
            p, at = line(at, 1)
            return [p], at
        n, at = struct.unpack_from(f"{e}I", wkb, at)[0], at + 4
        out = []
        if kind == 2:
            p, at = line(at, n)
            return [p], at
        for _ in range(n):
            if kind == 3:
                m, at = struct.unpack_from(f"{e}I", wkb, at)[0], at + 4
                p, at = line(at, m)
                out.append(p)
            else:
                p, at = one(at)
                out += p
        return out, at

    return one(0)[0]


@contextmanager
def _opened(path: str, content: bytes | None):
    """A read-only connection to the file at ``path``, or to ``content``, which sqlite needs as a file: gone with the task."""
    if content is None:
        con = sqlite3.connect(f"file:{quote(_local(path))}?mode=ro", uri=True)
        try:
            yield con
        finally:
            con.close()
        return
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(content)
        f.flush()
        with _opened(f.name, None) as con:
            yield con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _fit(values, kind: pa.DataType) -> pa.Array:
    """Values of any sqlite type as an array of ``kind``."""
    if pa.types.is_string(kind):
        values = [v if v is None or isinstance(v, str) else str(v) for v in values]
    elif pa.types.is_boolean(kind):
        values = [None if v is None else bool(v) for v in values]
    elif pa.types.is_floating(kind):
        values = [None if v is None else float(v) for v in values]
    return pa.array(values, kind)


def read_gpkg(spark: SparkSession, path: str, layer: str, attributes: str, geometry: str = "geom", features: int = FEATURES) -> DataFrame:
    """Features of a layer: ``attributes`` (DDL), wkb, and rings (arrays of struct(x, y)).

    ``path`` is a file or a folder of files. On a file system that the machines
    mount, a layer is cut into ranges of ``features`` row numbers, each read by a
    task through the table's own index; elsewhere a file is one task's. Shapes
    may be null.
    """
    ship(spark)
    names = [f.name for f in StructType.fromDDL(attributes)]
    out = StructType.fromDDL(f"{attributes}, wkb binary, rings array<array<struct<x: double, y: double>>>")
    shape = to_arrow_schema(out)
    columns = ", ".join(map(_quoted, [*names, geometry]))

    def ends(batches):
        for b in batches:
            found = []
            for at in b.column(0).to_pylist():
                with _opened(at, None) as con:
                    found.append((at, *con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(layer)}").fetchone()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "low", "high"])

    def run(batches):
        for b in batches:
            for at, raw, low, high in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                with _opened(at, raw.as_py()) as con:
                    within, bounds = ("", ()) if low is None else (" WHERE rowid BETWEEN ? AND ?", (low, high))
                    rows = con.execute(f"SELECT {columns} FROM {_quoted(layer)}{within}", bounds)
                    while part := rows.fetchmany(BATCH):
                        wkb = [None if r[-1] is None else wkb_of(r[-1]) for r in part]
                        rings = [None if not w else [[{"x": x, "y": y} for x, y in ring] for ring in rings_of(w)] for w in wkb]
                        own = [*zip(*(r[:-1] for r in part))] if names else []
                        yield pa.RecordBatch.from_arrays([_fit(v, f.type) for v, f in zip([*own, wkb, rings], shape)], schema=shape)

    files, by_path = _files(spark, path)
    if by_path:
        found = files.select("path").mapInArrow(ends, "path string, low long, high long").where("low is not null")
        low = F.explode(F.expr(f"sequence(low, high, {int(features)}L)")).alias("low")
        ranges = found.select("path", F.lit(None).cast("binary").alias("content"), low, "high")
        # a range is much work and a short row: dealt anew, so that those of one file are not one task
        ranges = ranges.withColumn("high", F.least("high", F.col("low") + (int(features) - 1))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "low")
    else:
        ranges = files.select("path", "content", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    return ranges.mapInArrow(run, out)


def attribute_lookup(layer: DataFrame, key: str, value: str) -> DataFrame:
    """A layer's attributes without shapes, one row for each key."""
    return layer.groupBy(key).agg(F.max(value).alias(value))


class Layer:
    """A GeoPackage at the local ``path`` with one layer; a row's last value is its WKB or null, the declared SRS is EPSG:``srs``."""

    def __init__(self, path: str, layer: str, names: list[str], srs: int = 4326):
        self.srs, self.con = srs, sqlite3.connect(path)
        self.con.executescript(
            "PRAGMA application_id = 1196444487;"
            "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);"
            "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"
        )
        self.con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        self.con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        self.con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))
        columns = "".join(f"{_quoted(n)}, " for n in names)
        self.con.execute(f"CREATE TABLE {_quoted(layer)} (fid INTEGER PRIMARY KEY, {columns}geom BLOB)")
        self.insert = f"INSERT INTO {_quoted(layer)} ({columns}geom) VALUES ({', '.join('?' * (len(names) + 1))})"

    def add(self, rows) -> None:
        self.con.executemany(self.insert, [(*map(_bound, r[:-1]), None if r[-1] is None else gpkg_blob(_shape(r[-1]), self.srs)) for r in rows])

    def close(self) -> None:
        self.con.commit()
        self.con.close()


def _bound(v):
    """A value as sqlite takes it: decimals, dates and times as texts."""
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def _shape(v) -> bytes:
    return point_wkb(v["x"], v["y"]) if isinstance(v, dict) else point_wkb(*v) if isinstance(v, tuple) else bytes(v)


def _write_parts(df: DataFrame, folder: str, suffix: str, most: int, begin) -> int:
    """Rows of ``df``, written by its tasks as files of at most ``most`` rows below ``folder``; returns their number.

    ``begin(path)`` gives a file with ``add`` and ``close``. A file is made on the
    task's own disk and then put into the folder under a name that follows from
    its partition and number and appears only when it is whole, so a task that
    runs again puts the same names. What the folder held before goes first.
    """
    spark = df.sparkSession
    ship(spark)
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(folder)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(to, True)
    fs.mkdirs(to)
    target = fs.makeQualified(to).toString()
    target = _local(target) if target.startswith("file:") else target

    def run(batches):
        from pyarrow import fs as stores
        from pyspark import TaskContext

        store, base = stores.FileSystem.from_uri(target)
        task, count, total = TaskContext.get(), 0, 0
        with tempfile.TemporaryDirectory() as scratch:
            here, out, held = os.path.join(scratch, "part"), None, 0

            def put():
                nonlocal out, held, count
                out.close()
                name = f"part-{task.partitionId():05d}-{count:04d}{suffix}"
                hidden = f"{base}/.{name}.{task.taskAttemptId()}"
                stores.copy_files(here, hidden, source_filesystem=stores.LocalFileSystem(), destination_filesystem=store)
                store.move(hidden, f"{base}/{name}")
                os.remove(here)
                out, held, count = None, 0, count + 1

            for b in batches:
                rows = [*zip(*(c.to_pylist() for c in b.columns))]
                while rows:
                    out = out or begin(here)
                    part, rows = rows[: most - held], rows[most - held :]
                    out.add(part)
                    held, total = held + len(part), total + len(part)
                    if held == most:
                        put()
            if out:
                put()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["rows"])

    return df.mapInArrow(run, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first().rows


def write_gpkg_parts(df: DataFrame, folder: str, layer: str, wkb: str = "wkb", srs: int = 4326, most: int = LAYER_ROWS) -> int:
    """``df`` as GeoPackages with one layer each, as many as its tasks need, none above ``most`` features; returns the number of rows.

    ``wkb`` holds WKB, a struct(x, y), which becomes a point, or null. No rows give an empty folder.
    """
    names = [c for c in df.columns if c != wkb]
    return _write_parts(df.select(*[f"`{c}`" for c in [*names, wkb]]), folder, ".gpkg", most, lambda path: Layer(path, layer, names, srs))


def write_xlsx_parts(df: DataFrame, folder: str, most: int = SHEET_ROWS - 1) -> int:
    """``df`` as workbooks with a header each, none above ``most`` rows; returns the number of rows."""
    columns = df.columns
    return _write_parts(df, folder, ".xlsx", min(most, SHEET_ROWS - 1), lambda path: Workbook(path, columns))


def put_file(spark: SparkSession, path: str, local: str) -> None:
    """Copy one file of the driver's to a store of Hadoop's."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(local), p)


#: An export to one workbook or GeoPackage is for reports; a larger result belongs in parts.
EXPORT_ROWS = 1_000_000


def _report(df: DataFrame, path: str, begin) -> None:
    rows = df.limit(EXPORT_ROWS + 1).collect()
    if len(rows) > EXPORT_ROWS:
        raise ValueError("too many rows for one file")
    with tempfile.TemporaryDirectory() as d:
        local = os.path.join(d, "out")
        out = begin(local)
        out.add(map(tuple, rows))
        out.close()
        put_file(df.sparkSession, path, local)


def write_gpkg(df: DataFrame, path: str, layer: str, wkb: str = "wkb", srs: int = 4326) -> None:
    """A report as one GeoPackage, see ``write_gpkg_parts``; ValueError over ``EXPORT_ROWS`` rows."""
    names = [c for c in df.columns if c != wkb]
    _report(df.select(*[f"`{c}`" for c in [*names, wkb]]), path, lambda local: Layer(local, layer, names, srs))


def write_xlsx(df: DataFrame, path: str) -> None:
    """A report as one workbook, its first sheet with a header; ValueError over ``EXPORT_ROWS`` rows."""
    columns = df.columns
    _report(df, path, lambda local: Workbook(local, columns))
