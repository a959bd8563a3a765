"""Sources and sinks: what is written is read back and must equal the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import point_if
from ..shared import remove_later, shared_folder
from ..sources import bucketed, delimited, geojson, office, typed
from .base import Tables, query, rounded


def folder(t: Tables) -> str:
    """A new folder where driver and executors both see it; it goes when the application ends."""
    at = f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"
    remove_later(t.spark, at)
    return at


NATIONS = "SELECT n_nationkey, n_name, n_nationkey * 0.5::DOUBLE AS lon, n_regionkey * 1.25::DOUBLE AS lat FROM nation"


def nations(t: Tables) -> DataFrame:
    return t("nation").select("n_nationkey", "n_name", (F.col("n_nationkey") * 0.5).alias("lon"), (F.col("n_regionkey") * 1.25).alias("lat"))


@query("""SELECT c_custkey, concat(c_name, ' {"', c_custkey % 7, '\\}]') AS name, c_custkey % 360 * 0.5::DOUBLE AS lon, c_custkey % 170 * 0.25::DOUBLE AS lat FROM customer""")
def geojson_source(t: Tables) -> DataFrame:
    """Points with braces and quotes in their names, from as many files as there are tasks, each read by blocks."""
    to, k = folder(t), F.col("c_custkey")
    name = F.concat("c_name", F.lit(' {"'), (k % 7).cast("string"), F.lit("\\}]")).alias("name")
    x = t("customer").select(k, name, F.array(point_if(F.lit(True), k % 360 * 0.5, k % 170 * 0.25)).alias("points"))
    geojson.write_geojson(x, to, "points", ["c_custkey", "name"])
    got = geojson.read_geojson(t.spark, to, "c_custkey long, name string", "Point")
    return got.select("c_custkey", "name", F.col("points")[0]["x"].alias("lon"), F.col("points")[0]["y"].alias("lat"))


@query(NATIONS)
def mif_mid_source(t: Tables) -> DataFrame:
    """Attributes in one file and points in the other, by position."""
    to, rows = folder(t), nations(t).sort("n_nationkey")
    head = "Version 300\nColumns 2\n  n_nationkey Integer\n  n_name Char(25)\nData"
    delimited.write_text(rows.select(F.concat(F.lit("Point "), "lon", F.lit(" "), "lat", F.lit("\n    Symbol (34,0,12)")).alias("value")), f"{to}/a.mif", head)
    delimited.write_text(rows.select(F.concat("n_nationkey", F.lit(',"'), "n_name", F.lit('"')).alias("value")), f"{to}/a.mid")
    return delimited.read_mif_mid(t.spark, f"{to}/a.mif", f"{to}/a.mid", "n_nationkey int, n_name string").drop("row_index")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS lga_code, n_name AS lga, r_name AS state FROM nation JOIN region ON r_regionkey = n_regionkey")
def xlsx_source(t: Tables) -> DataFrame:
    to = folder(t)
    x = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    office.write_xlsx_parts(x.select(F.col("r_name").alias("a"), F.col("n_name").alias("b"), F.col("n_nationkey").alias("c")), to)
    return office.read_xlsx(t.spark, to, ["state", "lga", "lga_code"]).select("lga_code", "lga", "state")


@query(f"SELECT n_nationkey, n_name, lon, lat FROM ({NATIONS})")
def gpkg_source(t: Tables) -> DataFrame:
    to = folder(t)
    office.write_gpkg_parts(nations(t).select("n_nationkey", "n_name", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("shape")), to, "wards", "shape")
    got = office.read_gpkg(t.spark, to, "wards", "n_nationkey int, n_name string")
    return got.select("n_nationkey", "n_name", F.col("rings")[0][0]["x"].alias("lon"), F.col("rings")[0][0]["y"].alias("lat"))


@query("SELECT lga_code, max(sen) AS sen FROM (SELECT n_name AS lga_code, CAST(n_regionkey AS VARCHAR) AS sen FROM nation) GROUP BY 1")
def gpkg_lookup(t: Tables) -> DataFrame:
    to = folder(t)
    shape = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("shape")
    office.write_gpkg_parts(t("nation").select(F.col("n_name").alias("lga_code"), F.col("n_regionkey").cast("string").alias("sen"), shape), to, "lgas", "shape")
    return office.attribute_lookup(office.read_gpkg(t.spark, to, "lgas", "lga_code string, sen string"), "lga_code", "sen")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'x' END AS note FROM supplier")
def sink_roundtrip(t: Tables) -> DataFrame:
    """CSV out and in; a text that means missing comes back as null."""
    to = folder(t)
    x = t("supplier").select("s_suppkey", "s_name", "s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, "N/A").otherwise("x").alias("note"))
    delimited.write_csv(x, to)
    return rounded(delimited.read_csv(t.spark, to, "s_suppkey long, s_name string, s_acctbal double, note string"), 2)


@query("""SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, c_custkey, concat('a "note" of', chr(10), c_name, ', ', c_mktsegment) AS note FROM customer""")
def headless_source(t: Tables) -> DataFrame:
    """Customers by falling balance in one file, in which notes hold quotes and line feeds; read back with their places."""
    to = f"{folder(t)}/notes.csv"
    note = F.concat(F.lit('a "note" of\n'), "c_name", F.lit(", "), "c_mktsegment").alias("note")
    delimited.write_csv(t("customer").select("c_custkey", note, "c_acctbal"), to, one_file=True, order=["-c_acctbal", "c_custkey"], quoteAll=True, escape='"')
    got = delimited.read_headless(t.spark, to, "c_custkey long, note string, c_acctbal double", "UTF-8").where("row_index > 0")
    return got.select(F.col("row_index").alias("place"), "c_custkey", "note")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def ctas_table(t: Tables) -> DataFrame:
    """A result written as a table and replaced, then read by name."""
    name = f"gapwise_{uuid.uuid4().hex}"
    for _ in range(2):
        t("nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).write.mode("overwrite").option("path", folder(t)).saveAsTable(name)
    return t.spark.table(name)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 = 1 END AS visited, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 40 END AS beds, CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 0.25::DOUBLE END AS balance,
concat('00', c_custkey % 50) AS code, CASE WHEN c_custkey % 2 = 0 THEN '12' ELSE 'a,b' END AS note, concat('9', repeat('0', 15), 1000 + c_custkey % 1000) AS long_code, CAST(NULL AS DOUBLE) AS remarks FROM customer""")
def csv_typed(t: Tables) -> DataFrame:
    """All customers by a CSV whose types come from the data: truth values, whole and decimal numbers, text, with missing values."""
    to, k = folder(t), F.col("c_custkey")
    visited = F.when(k % 3 == 0, "NA").when(k % 3 == 1, "True").otherwise("false").alias("visited")
    beds = F.when(k % 7 == 0, "n/a").otherwise((k % 40).cast("string")).alias("beds")
    balance = F.when(k % 5 == 0, "NaN").otherwise((k * 0.25).cast("string")).alias("balance")
    note = F.when(k % 2 == 0, "12").otherwise("a,b").alias("note")
    code, wide = F.concat(F.lit("00"), k % 50).alias("code"), F.concat(F.lit("9" + "0" * 15), 1000 + k % 1000).alias("long_code")
    delimited.write_csv(t("customer").select(k, visited, beds, balance, code, note, wide, F.lit("").alias("remarks")), to)
    return typed.read_typed_csv(t.spark, to, text=("code",))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")
def csv_in_sql(t: Tables) -> DataFrame:
    """SQL over two CSV files as relations, numbers as their texts say."""
    orders, customers = folder(t), folder(t)
    delimited.write_csv(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), orders)
    delimited.write_csv(t("customer").select("c_custkey", "c_mktsegment"), customers)
    typed.csv_relation(t.spark, "gapwise_csv_orders", orders)
    typed.csv_relation(t.spark, "gapwise_csv_customers", customers)
    return t.spark.sql("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM gapwise_csv_orders JOIN gapwise_csv_customers ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")


@query("SELECT c_custkey, c_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def bucketed_join(t: Tables) -> DataFrame:
    """Customers and their orders from two tables in buckets: neither join nor grouping moves rows."""
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"gapwise_{uuid.uuid4().hex}"
    c = bucketed.write_bucketed(t("customer").select("c_custkey", "c_name"), f"{name}_c", ["c_custkey"], n, folder(t))
    o = bucketed.write_bucketed(t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice"), f"{name}_o", ["c_custkey"], n, folder(t))
    return c.join(o.hint("merge"), "c_custkey").groupBy("c_custkey", "c_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 360 * 0.5::DOUBLE END AS lon, CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 170 * 0.25::DOUBLE END AS lat FROM customer")
def gpkg_parts(t: Tables) -> DataFrame:
    """All customers as GeoPackages of at most 40,000 features, read by ranges of 10,000; some without values or shapes."""
    to, k = folder(t), F.col("c_custkey")
    point = F.when(k % 11 > 0, F.struct((k % 360 * 0.5).alias("x"), (k % 170 * 0.25).alias("y"))).alias("shape")
    x = t("customer").select(k, "c_name", F.when(k % 6 > 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 7 > 0, F.col("c_acctbal")).alias("balance"), point)
    office.write_gpkg_parts(x, to, "wards", "shape", most=40_000)
    got = office.read_gpkg(t.spark, to, "wards", "c_custkey long, c_name string, segment string, balance double", features=10_000)
    return got.select("c_custkey", "c_name", "segment", "balance", F.col("rings")[0][0]["x"].alias("lon"), F.col("rings")[0][0]["y"].alias("lat"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority, CASE WHEN o_orderkey % 5 > 0 THEN concat('<', o_orderstatus, '> & ', chr(34), 'x', chr(34)) END AS note FROM orders")
def xlsx_parts(t: Tables) -> DataFrame:
    """All orders as workbooks, texts with markup and missing cells among them, read one task a workbook."""
    to = folder(t)
    note = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("<"), "o_orderstatus", F.lit('> & "x"'))).alias("note")
    office.write_xlsx_parts(t("orders").select("o_orderkey", "o_orderpriority", note), to, most=50_000)
    return office.read_xlsx(t.spark, to, ["id", "priority", "note"]).drop("row_index")
