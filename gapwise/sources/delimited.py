"""CSV sources and sinks, and the two-file MapInfo interchange format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import na_to_null
from ..operators.tables import positional_join
from .splits import csv_records, numbered, pieces


def read_csv(spark: SparkSession, path: str, schema: str | None = None, na: bool = True, **options) -> DataFrame:
    """A CSV with a header; all columns are text unless a schema is given. ``na``: texts that mean missing are null."""
    r = spark.read.option("header", True).options(**options)
    df = (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)
    return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes]) if na else df


def read_headless(spark: SparkSession, path: str, ddl: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A CSV without a header, with the names and types of ``ddl`` and row_index, the record's place in its file.

    A file is read by as many tasks as it has blocks; a quoted line feed belongs
    to its record. Blank lines count as places and give no row.
    """
    records = csv_records(pieces(spark, path, encoding=encoding))
    return records.where(F.trim("text") != "").select("row_index", F.from_csv("text", ddl, {"escape": '"'}).alias("r")).select("row_index", "r.*")


def read_mif_points(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(row_index, lon, lat) of the Point lines of a .mif file, numbered in file order over all its blocks."""
    number = r"([-+0-9.eE]+)"
    point = rf"(?i)^\s*Point\s+{number}\s+{number}"
    x = numbered(pieces(spark, path, encoding=encoding).where(F.col("text").rlike(point)))
    part = lambda i: F.regexp_extract("text", point, i).cast("double")
    return x.select("row_index", part(1).alias("lon"), part(2).alias("lat"))


def read_mif_mid(spark: SparkSession, mif: str, mid: str, ddl: str) -> DataFrame:
    """Rows of the .mid with the point at the same place of the .mif; ValueError if their counts differ."""
    return positional_join(read_headless(spark, mid, ddl), read_mif_points(spark, mif))


def write_csv(df: DataFrame, path: str, one_file: bool = False, order: list[str] | None = None, **options) -> None:
    """A folder of CSV files with headers. With ``one_file`` ``path`` is a file.

    Rows go by ``order`` (names, each ``-name`` to fall) if it is given: they are
    sorted into ranges, written in parallel, and one file is put together from
    the parts in their order by copying bytes, never by one task that sorts.
    """
    if not one_file:
        df = df.sort(*_keys(order)) if order else df
        df.write.mode("overwrite").option("header", True).options(**options).csv(path)
        return
    rows = df.sort(*_keys(order)) if order else df
    rows.write.mode("overwrite").option("header", False).options(**options).csv(f"{path}.parts")
    header = df.sparkSession.range(1).select(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(df.columns)])
    header.write.mode("overwrite").option("header", False).options(**options).csv(f"{path}.header")
    concatenate(df.sparkSession, [f"{path}.header", f"{path}.parts"], path)


def write_text(rows: DataFrame, path: str, header: str | None = None) -> None:
    """One text file of the only column of ``rows``, in their order, after the lines of ``header``; as ``write_csv`` puts it together."""
    spark, folders = rows.sparkSession, [f"{path}.parts"]
    if header is not None:
        spark.range(1).select(F.lit(header).alias("value")).write.mode("overwrite").text(f"{path}.header")
        folders.insert(0, f"{path}.header")
    rows.write.mode("overwrite").text(f"{path}.parts")
    concatenate(spark, folders, path)


def _keys(order: list[str]) -> list:
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]


def concatenate(spark: SparkSession, folders: list[str], path: str) -> None:
    """The part files of ``folders``, by name, as one file ``path`` of the same file system; the folders go."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(conf)
    out = fs.create(P(path), True)
    for folder in folders:
        found = sorted(f.getPath().toString() for f in fs.listStatus(P(folder)) if f.getPath().getName().startswith("part-"))
        for f in found:
            part = fs.open(P(f))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    out.close()
    for folder in folders:
        fs.delete(P(folder), True)
