"""GeoJSON lines and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ship
from .splits import json_objects


def read_geojson(spark: SparkSession, path: str, properties: str, kind: str = "LineString") -> DataFrame:
    """One row for each feature of a FeatureCollection: its place in the file, ``properties`` (DDL) and its points.

    Points are arrays of struct(x, y); a Point has one. A file is read by as many
    tasks as it has blocks (``json_objects``); features of another geometry keep
    their place and give no row.
    """
    depth = {"Point": "array<double>", "LineString": "array<array<double>>"}[kind]
    kinds = json_objects(spark, path).select("file", "row_index", F.from_json("text", "type string, geometry struct<type: string>").alias("k"), "text").where("k.type = 'Feature'")
    first = kinds.groupBy("file").agg(F.min("row_index").alias("first"))  # other members may stand before the features
    x = kinds.where(F.col("k.geometry.type") == kind).join(F.broadcast(first), "file").select((F.col("row_index") - F.col("first")).cast("int").alias("ord"), F.from_json("text", f"properties struct<{properties}>, geometry struct<coordinates: {depth}>").alias("f"))
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    points = F.transform("f.geometry.coordinates", xy) if kind == "LineString" else F.array(xy(F.col("f.geometry.coordinates")))
    return x.select("ord", "f.properties.*", points.alias("points"))


def as_geojson(rows: DataFrame, points: str, properties: list[str], kind: str = "Point") -> DataFrame:
    """One JSON text (column value) for each feature."""
    p = F.col(points)
    pairs = F.transform(p, lambda x: F.array(x["x"], x["y"]))
    coordinates = pairs if kind == "LineString" else pairs[0]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return rows.select(F.to_json(feature).alias("value"))


def write_geojson(rows: DataFrame, path: str, points: str, properties: list[str], kind: str = "Point") -> None:
    """A folder of FeatureCollections, one a partition, each a file that ``read_geojson`` takes."""
    ship(rows.sparkSession)

    def wrap(batches):
        import pyarrow as pa

        sep = '{"type":"FeatureCollection","features":['
        for b in batches:
            for v in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([sep + v])], ["value"])
                sep = ","
        if sep == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    as_geojson(rows, points, properties, kind).mapInArrow(wrap, "value string").write.mode("overwrite").text(path)
