"""Facility access, end to end and lazily: each function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coordinates, names, rules
from ..functions.nulls import na_to_null, optional
from ..operators import matching, network, tables
from ..operators.describe import quantiles
from . import metrics


def build_crosswalk(sheet: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """One row for each lga_code from a sheet with merged cells.

    ``sheet``: row_index and six columns that are named by position. ``trusted``
    (lga_code, sen) is the boundary layer's own answer for codes that occur twice.
    """
    x = sheet.toDF("row_index", "state", "lga", "senatorial_district", "n_wards", "lga_code", "remarks")
    x = tables.forward_fill(x.where(names.is_data_row(F.col("lga"))), ["state", "senatorial_district"], "row_index")
    x = x.withColumn("lga_norm", names.normalize_lga_name(F.col("lga")))
    hit = F.lit(False)
    if trusted is not None:
        x = x.join(trusted.select("lga_code", F.col("sen").alias("__sen")), "lga_code", "left")
        hit = F.coalesce(names.agrees(F.col("senatorial_district"), F.col("__sen")), F.lit(False))
    out = tables.pick_by_rule(x, "lga_code", hit, names.mentions(F.col("remarks"), "gazette"), F.col("row_index"))
    return out.drop("__sen")


def clean_register(register: DataFrame, crosswalk: DataFrame, threshold: float = 85.0) -> tuple[DataFrame, DataFrame]:
    """(register with clean columns, reconciliation log); both are projections of the same rows."""
    r = register.select(*[na_to_null(F.col(c)).alias(c) for c in register.columns])
    r = r.where(~names.is_junk_name(F.col("facility_name")))
    lon, lat = coordinates.parse_coordinate(F.col("longitude")), coordinates.parse_coordinate(F.col("latitude"))
    r = r.withColumns({"lon": lon, "lat": lat, "lga_norm": names.normalize_lga_name(F.col("lga_name")), "own_sen": optional(r, "sen_district")})
    r = r.withColumn("coord_status", coordinates.coord_status(F.col("lon.value"), F.col("lat.value")))
    m = matching.fuzzy_best_match(r, "lga_norm", crosswalk, "lga_norm", threshold)
    # equal names of two states resolve to the first row of the sheet
    one = tables.first_per_key(crosswalk, ["lga_norm"], F.col("row_index")).select(F.col("lga_norm").alias("matched"), F.col("lga_code").alias("matched_lga_code"), F.col("lga").alias("matched_lga_canonical"), F.col("senatorial_district").alias("matched_sen_district"))
    m = m.join(one, "matched", "left").withColumn("sen_district_agrees", F.when(F.col("matched").isNotNull(), names.agrees(F.col("own_sen"), F.col("matched_sen_district"))))
    keep = F.col("coord_status") == "included"
    added = ["coord_status", "matched_lga_code", "matched_lga_canonical", "matched_sen_district", "sen_district_agrees"]
    clean = m.select(*register.columns, F.when(keep, F.col("lon.value")).alias("longitude_clean"), F.when(keep, F.col("lat.value")).alias("latitude_clean"), *added)
    log = m.select("facility_id", F.col("lga_name").alias("raw_lga_name"), F.col("own_sen").alias("raw_sen_district"), F.col("longitude").alias("raw_longitude"), F.col("latitude").alias("raw_latitude"), F.col("lon.method").alias("lon_parse_method"), F.col("lat.method").alias("lat_parse_method"), "coord_status", F.col("match_method").alias("lga_match_method"), F.col("match_score").alias("lga_match_score"), *added[1:])
    return clean, log


def classify_adequacy(facilities: DataFrame, personnel: DataFrame, norms: DataFrame) -> DataFrame:
    """Facilities with their staff, norms and adequacy_status.

    The last norm of a type counts, whole: the one with the most ``row_index``
    if ``norms`` has that column (its place in the file), else the greatest by its minima.
    """
    counts = [c for c, _ in rules.CADRES]
    minima = [m for _, m in rules.CADRES]
    place = [F.col("row_index")] if "row_index" in norms.columns else []
    last = norms.groupBy("facility_type").agg(F.max(F.struct(*place, *minima)).alias("n")).select("facility_type", *[f"n.{m}" for m in minima])
    x = facilities.join(personnel.select("facility_id", *counts), "facility_id", "left").join(last.withColumn("__known", F.lit(True)), "facility_type", "left")
    return x.withColumn("adequacy_status", rules.adequacy(F.col("__known").isNotNull(), F.col("med_officers").isNotNull())).drop("__known")


def classify_gaps(wards: DataFrame, facilities: DataFrame, roads: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Wards (ward_code, lon, lat, ...) with their travel times and gap type.

    ``facilities``: facility_id, lon, lat, adequacy_status. ``roads``: line (its
    place in the file), speed (km/h), points. Minutes are rounded before they
    are compared with ``threshold``.
    """
    g = network.road_graph(network.road_segments(roads, "points", "speed", "line"))
    ends = g.select(F.col("a").alias("p")).unionByName(g.select(F.col("b").alias("p"))).distinct()
    key: Column = F.concat_ws(" ", F.col("p.x").cast("string"), F.col("p.y").cast("string"))
    nodes = ends.select(key.alias("node_id"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    text = lambda c: F.concat_ws(" ", F.col(f"{c}.x").cast("string"), F.col(f"{c}.y").cast("string"))
    edges = network.both_ways(g.select(text("a").alias("a"), text("b").alias("b"), "weight"))
    both = {"adequate": F.col("adequacy_status") == "adequate", "any": F.lit(True)}
    near = network.nearest_by_network(wards, facilities, nodes, edges, "ward_code", "facility_id", both)
    near = near.select("ward_code", F.col("adequate_minutes").alias("travel_time_to_adequate_min"), F.col("adequate_facility_id").alias("nearest_adequate_facility_id"), F.col("any_minutes").alias("travel_time_to_any_facility_min"), F.col("any_facility_id").alias("nearest_any_facility_id"))
    x = wards.join(near, "ward_code", "left")
    return x.withColumn("gap_type", rules.gap_type(F.col("travel_time_to_adequate_min"), F.col("travel_time_to_any_facility_min"), threshold))


def most_severe(gaps: DataFrame, n: int = 15) -> DataFrame:
    """The worst ``n`` wards of each kind of gap, without those that are served."""
    x = gaps.where("gap_type <> 'adequately_served'")
    top = tables.top_per_group(x, "gap_type", n, F.desc_nulls_last("travel_time_to_adequate_min"), F.asc_nulls_last("ward_code"))
    return top.orderBy("gap_type", "severity_rank")


def summary(gaps: DataFrame, population: str = "total_population") -> DataFrame:
    """Wards, people and the exact median time by gap type, in place of printed lines.

    The median of each type is taken in passes over its column, so no task holds
    the times of a type; there are as many passes as the fixed types of gaps.
    """
    minutes = "travel_time_to_adequate_min"
    out = gaps.groupBy("gap_type").agg(F.count("*").alias("n_wards"), F.sum(population).alias("people"))
    medians = [(g, quantiles(gaps.where(F.col("gap_type") == g), minutes, [0.5])[0]) for g in rules.GAP_TYPES]
    middle = gaps.sparkSession.createDataFrame(medians, "gap_type string, median_min double")
    return out.join(F.broadcast(middle), "gap_type", "left")


def metric_stages(crosswalk: DataFrame, threshold: float = 85.0) -> list[metrics.Stage]:
    """The register's cleaning as stages for ``metrics.run_stages``: rows that are no facilities, clean columns, places within bounds."""
    clean = lambda r: clean_register(r, crosswalk, threshold)[0]
    found = metrics.shares("coord_status", coordinates.STATUSES) | {"matched": F.count("matched_lga_code"), "district_disagrees": F.count_if(~F.col("sen_district_agrees"))}
    return [
        ("facilities", lambda r: r.where(~names.is_junk_name(na_to_null(F.col("facility_name")))), {"without_place": F.count_if(F.col("longitude").isNull() | F.col("latitude").isNull())}),
        ("clean", clean, found | metrics.spread("longitude_clean", "latitude_clean")),
        ("placed", lambda c: c.where("coord_status = 'included'"), {"matched": F.count("matched_lga_code")}),
    ]
