"""The register's cleaning from end to end: its log and its metrics. Register: customer; crosswalk: nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..plans import access, metrics
from .base import Tables, query
from .files import folder


def crosswalk(t: Tables) -> DataFrame:
    n = t("nation").select(F.col("n_nationkey").alias("row_index"), F.col("n_name").alias("lga"), F.concat(F.lit("L"), "n_nationkey").alias("lga_code"), F.when(F.col("n_nationkey") % 3 == 0, "South").otherwise("North").alias("senatorial_district"))
    return n.withColumn("lga_norm", names.normalize_lga_name(F.col("lga")))


def register(t: Tables) -> DataFrame:
    """Customers as facilities: some unnamed, some without a place or an area, areas with suffix, places in and out of the box."""
    k = F.col("c_custkey")
    x = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    name = F.when(k % 9 == 0, "Unnamed Facility").otherwise(F.col("c_name")).alias("facility_name")
    area = F.when(k % 10 == 0, "NA").otherwise(F.concat("n_name", F.lit(" LGA"))).alias("lga_name")
    district = F.when(k % 8 > 0, " NORTH ").alias("sen_district")
    longitude = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.concat((k % 20).cast("string"), F.lit(",5"))).otherwise((k % 20).cast("string")).alias("longitude")
    return x.select(k.cast("string").alias("facility_id"), name, area, district, longitude, F.lit("8°30'0\"N").alias("latitude"))


REGISTER_SQL = """r AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS facility_id, CASE WHEN c_custkey % 10 > 0 THEN concat(n_name, ' LGA') END AS raw_lga_name, CASE WHEN c_custkey % 8 > 0 THEN ' NORTH ' END AS raw_sen_district,
CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN concat(c_custkey % 20, ',5') ELSE CAST(c_custkey % 20 AS VARCHAR) END AS raw_longitude,
CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 20 + CASE WHEN c_custkey % 4 = 1 THEN 0.5 ELSE 0.0 END END::DOUBLE AS lon,
CASE WHEN c_custkey % 10 > 0 THEN concat('L', n_nationkey) END AS matched_lga_code, CASE WHEN c_custkey % 10 > 0 THEN n_name END AS matched_lga_canonical,
CASE WHEN c_custkey % 10 > 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'South' ELSE 'North' END END AS matched_sen_district FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT *, CASE WHEN lon IS NULL THEN 'excluded_missing_or_unparseable' WHEN lon BETWEEN 2.5 AND 15 THEN 'included' ELSE 'excluded_out_of_bounds' END AS coord_status,
CASE WHEN matched_lga_code IS NOT NULL AND raw_sen_district IS NOT NULL THEN matched_sen_district = 'North' END AS sen_district_agrees FROM r WHERE k % 9 > 0)"""


@query(f"""WITH {REGISTER_SQL} SELECT facility_id, raw_lga_name, raw_sen_district, raw_longitude, concat('8°30''0', chr(34), 'N') AS raw_latitude,
CASE k % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'comma_decimal' ELSE 'clean' END AS lon_parse_method, 'dms' AS lat_parse_method, coord_status, CASE WHEN raw_lga_name IS NULL THEN 'missing' ELSE 'exact' END AS lga_match_method,
CASE WHEN raw_lga_name IS NOT NULL THEN 100.0::DOUBLE END AS lga_match_score, matched_lga_code, matched_lga_canonical, matched_sen_district, sen_district_agrees FROM c""")
def reconciliation_log(t: Tables) -> DataFrame:
    """The whole log of a register's cleaning: raw texts, how each was read, the match and its score."""
    return access.clean_register(register(t), crosswalk(t))[1]


@query(f"""WITH {REGISTER_SQL}, m AS (SELECT 0 AS stage_no, 'facilities' AS stage, unnest(['rows_in', 'rows_out', 'rows_dropped', 'without_place']) AS metric,
unnest([(SELECT count(*) FROM r), count(*), (SELECT count(*) FROM r) - count(*), count_if(lon IS NULL)]) AS value FROM c
UNION ALL SELECT 1, 'clean', unnest(['rows_in', 'rows_out', 'rows_dropped', 'coord_status_included', 'coord_status_excluded_missing_or_unparseable', 'coord_status_excluded_out_of_bounds', 'matched', 'district_disagrees', 'longitude_clean_missing', 'longitude_clean_least', 'longitude_clean_most', 'latitude_clean_missing', 'latitude_clean_least', 'latitude_clean_most']),
unnest([count(*), count(*), 0, count_if(coord_status = 'included'), count_if(lon IS NULL), count_if(coord_status = 'excluded_out_of_bounds'), count(matched_lga_code), count_if(NOT sen_district_agrees), count_if(coord_status <> 'included'), min(lon) FILTER (coord_status = 'included'), max(lon) FILTER (coord_status = 'included'), count_if(coord_status <> 'included'), 8.5, 8.5]) FROM c
UNION ALL SELECT 2, 'placed', unnest(['rows_in', 'rows_out', 'rows_dropped', 'matched']), unnest([count(*), count_if(coord_status = 'included'), count_if(coord_status <> 'included'), count_if(coord_status = 'included' AND matched_lga_code IS NOT NULL)]) FROM c)
SELECT stage_no, stage, metric, CAST(value AS DOUBLE) AS value FROM m""")
def stage_metrics(t: Tables) -> DataFrame:
    """Counts, drops and ranges of each stage of the cleaning, observed while the stages are written."""
    return metrics.run_stages(register(t), access.metric_stages(crosswalk(t)), folder(t))[1]
