"""Relational operators: selection, joins, updates, duplicates, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coordinates, names, rules
from ..functions.nulls import optional
from ..functions.rules import adequacy
from ..operators import matching, tables
from .base import Tables, query, rounded


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' Unnamed Facility ' ELSE p_name END AS name FROM part WHERE p_partkey % 5 <> 0")
def junk_filter(t: Tables) -> DataFrame:
    x = t("part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " Unnamed Facility ").otherwise(F.col("p_name")).alias("name"))
    return x.where(~names.is_junk_name(F.col("name")))


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 6 > 2")
def title_filter(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    x = t("part").select("p_partkey", F.when(k == 0, F.lit(None)).when(k == 1, " \t").when(k == 2, " total ").otherwise(F.col("p_name")).alias("name"))
    return x.where(names.is_data_row(F.col("name")))


LON, LAT = "(c_custkey % 180) * 0.1", "(c_custkey % 170) * 0.1"


@query(f"SELECT c_custkey, round({LON}::DOUBLE, 6) AS lon, round({LAT}::DOUBLE, 6) AS lat FROM customer WHERE {LON} BETWEEN 2.5 AND 15 AND {LAT} BETWEEN 4 AND 14")
def bbox_filter(t: Tables) -> DataFrame:
    x = t("customer").select("c_custkey", F.round((F.col("c_custkey") % 180) * 0.1, 6).alias("lon"), F.round((F.col("c_custkey") % 170) * 0.1, 6).alias("lat"))
    return x.where(F.col("lon").between(2.5, 15.0) & F.col("lat").between(4.0, 14.0))


@query(f"""WITH x AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {LON} END AS lon, {LAT} AS lat FROM customer)
SELECT CASE WHEN lon IS NULL OR lat IS NULL THEN 'excluded_missing_or_unparseable' WHEN lon BETWEEN 2.5 AND 15 AND lat BETWEEN 4 AND 14 THEN 'included' ELSE 'excluded_out_of_bounds' END AS coord_status, count(*) AS n FROM x GROUP BY 1""")
def coord_status(t: Tables) -> DataFrame:
    lon, lat = F.round((F.col("c_custkey") % 180) * 0.1, 6), F.round((F.col("c_custkey") % 170) * 0.1, 6)
    return t("customer").groupBy(coordinates.coord_status(F.when(F.col("c_custkey") % 11 != 0, lon), lat).alias("coord_status")).agg(F.count("*").alias("n"))


RAW = """CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(c_custkey % 180, '.', c_custkey % 1000) WHEN 3 THEN concat(c_custkey % 12, ',', 100 + c_custkey % 900, ',', 100 + c_custkey % 900)
WHEN 4 THEN concat(c_custkey % 15, '°', c_custkey % 60, '''', c_custkey % 59, '"', CASE WHEN c_custkey % 16 = 4 THEN 'N' ELSE 'S' END) WHEN 5 THEN concat(c_custkey % 15, '°', c_custkey % 60, '''') WHEN 6 THEN concat(1 + c_custkey % 9, CASE WHEN c_custkey % 16 = 6 THEN ',908,' ELSE 'd' END) ELSE CASE WHEN c_custkey % 16 = 7 THEN concat(c_custkey % 7, '°30’.5”W') ELSE concat('-', c_custkey % 7, ',9') END END"""


@query(f"""WITH x AS (SELECT c_custkey, c_custkey % 8 AS k, {RAW} AS raw FROM customer)
SELECT c_custkey, round(CASE WHEN k = 2 THEN raw::DOUBLE WHEN k = 3 AND c_custkey % 12 >= 0 THEN concat(c_custkey % 12, '.', 100 + c_custkey % 900, 100 + c_custkey % 900)::DOUBLE
WHEN k = 4 THEN (CASE WHEN c_custkey % 16 = 4 THEN 1.0 ELSE -1.0 END) * ((c_custkey % 15)::DOUBLE + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 59) / 3600.0::DOUBLE)
WHEN c_custkey % 16 = 6 THEN 1 + c_custkey % 9 + 0.908::DOUBLE WHEN c_custkey % 16 = 7 THEN -((c_custkey % 7)::DOUBLE + 30 / 60.0::DOUBLE + 0.5::DOUBLE / 3600.0::DOUBLE) END, 6) + 0.0::DOUBLE AS value,
CASE WHEN k IN (0, 1) THEN 'missing' WHEN k = 2 THEN 'clean' WHEN k = 3 OR c_custkey % 16 = 6 THEN 'comma_decimal' WHEN k = 4 OR c_custkey % 16 = 7 THEN 'dms' ELSE 'unparseable' END AS method FROM x""")
def parse_coordinates(t: Tables) -> DataFrame:
    raw = F.expr(RAW.replace("''''", '"\'"').replace("'\"'", "'\\\"'"))
    x = t("customer").select("c_custkey", coordinates.parse_coordinate(raw).alias("p"))
    return rounded(x.select("c_custkey", F.col("p.value").alias("value"), F.col("p.method").alias("method")))


SUFFIX = "CASE s_suppkey % 4 WHEN 0 THEN concat('  ', s_name, '  LGA ') WHEN 1 THEN concat(s_name, ' local govt area') WHEN 2 THEN concat('A   ', s_name) ELSE 'LGA' END"


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN lower(s_name) WHEN 1 THEN lower(s_name) WHEN 2 THEN concat('a ', lower(s_name)) ELSE 'lga' END AS name FROM supplier")
def normalize_names(t: Tables) -> DataFrame:
    return t("supplier").select("s_suppkey", names.normalize_lga_name(F.expr(SUFFIX)).alias("name"))


@query("SELECT n_nationkey AS row_idx, first_value(r_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS state, n_name AS lga FROM nation JOIN region ON r_regionkey = n_regionkey")
def crosswalk_ffill(t: Tables) -> DataFrame:
    """A sheet whose state stands on the first row of each block only."""
    x = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    first = x.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    sheet = x.join(first, "n_regionkey").select((F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("a"), F.when(F.col("n_nationkey") == F.col("first"), F.col("r_name")).alias("b"), F.col("n_name").alias("c"), F.col("n_nationkey").alias("d"))
    sheet = sheet.toDF("row_idx", "state", "lga", "key")
    filled = tables.forward_fill(sheet.where(names.is_data_row(F.col("lga"))), ["state"], "row_idx")
    return filled.select(F.col("key").alias("row_idx"), "state", "lga")


DUP = "SELECT o_orderkey AS row_idx, o_custkey AS lga_code, o_orderpriority AS sen, CASE WHEN o_orderkey % 5 = 0 THEN 'see Gazette 4' END AS remarks FROM orders"


@query(f"""WITH x AS ({DUP}), y AS (SELECT *, count(*) OVER (PARTITION BY lga_code) > 1 AS is_duplicate, coalesce(sen = '1-URGENT', false) AS hit, coalesce(lower(remarks) LIKE '%gazette%', false) AS pref FROM x),
z AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY lga_code) AS hits FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY lga_code ORDER BY CASE WHEN hits = 1 AND hit THEN 0 WHEN hits <> 1 AND pref THEN 1 ELSE 2 END, row_idx) AS k FROM z)
SELECT row_idx, lga_code, sen, is_duplicate FROM r WHERE k = 1""")
def duplicate_resolution(t: Tables) -> DataFrame:
    x = t("orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").alias("lga_code"), F.col("o_orderpriority").alias("sen"), F.when(F.col("o_orderkey") % 5 == 0, "see Gazette 4").alias("remarks"))
    x = tables.flag_duplicates(x, "lga_code")
    hit = F.coalesce(F.col("sen") == "1-URGENT", F.lit(False))
    return tables.pick_by_rule(x, "lga_code", hit, names.mentions(F.col("remarks"), "gazette"), F.col("row_idx")).select("row_idx", "lga_code", "sen", "is_duplicate")


#: CTEs over x (name) and k (choice), without empty ones: s has the score of each name that is no choice with each choice, best each name's
#: best. A common subsequence is a fold over the letters of v, each as bits of its places in u; windows of v are slices of that list.
FUZZY_INPUT_SQL = """x AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN concat(s_name[1:3], s_name[5:]) WHEN 2 THEN lower(s_name) WHEN 3 THEN NULL ELSE concat('no such place ', reverse(s_name)) END AS name FROM supplier),
k AS (SELECT DISTINCT s_name AS choice FROM supplier)"""
SCORES_SQL = """p AS (SELECT name, choice, list_filter(string_split(name, ' '), lambda t: t <> '') AS a, list_filter(string_split(choice, ' '), lambda t: t <> '') AS b FROM (SELECT DISTINCT name FROM x WHERE name NOT IN (SELECT choice FROM k)), k),
q AS (SELECT *, list_sort(list_distinct(list_intersect(a, b))) AS shared, list_sort(list_distinct(list_filter(a, lambda t: NOT list_contains(b, t)))) AS l, list_sort(list_distinct(list_filter(b, lambda t: NOT list_contains(a, t)))) AS r,
greatest(len(name), len(choice)) / least(len(name), len(choice))::DOUBLE AS lengths, array_to_string(list_sort(a), ' ') AS sa, array_to_string(list_sort(b), ' ') AS sb FROM p),
forms AS (SELECT name, choice, unnest(CASE WHEN lengths < 1.5 THEN [{'u': name, 'v': choice, 'f': 1.0::DOUBLE, 'part': false}, {'u': sa, 'v': sb, 'f': 0.95::DOUBLE, 'part': false},
{'u': array_to_string(list_concat(shared, l), ' '), 'v': array_to_string(list_concat(shared, r), ' '), 'f': 0.95::DOUBLE, 'part': false},
{'u': array_to_string(shared, ' '), 'v': array_to_string(list_concat(shared, l), ' '), 'f': CASE WHEN len(shared) > 0 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END, 'part': false},
{'u': array_to_string(shared, ' '), 'v': array_to_string(list_concat(shared, r), ' '), 'f': CASE WHEN len(shared) > 0 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END, 'part': false}]
ELSE [{'u': name, 'v': choice, 'f': 1.0::DOUBLE, 'part': false}, {'u': name, 'v': choice, 'f': scale, 'part': true}, {'u': sa, 'v': sb, 'f': 0.95 * scale, 'part': true},
{'u': array_to_string(l, ' '), 'v': array_to_string(r, ' '), 'f': CASE WHEN len(shared) = 0 THEN 0.95 * scale ELSE 0.0::DOUBLE END, 'part': true},
{'u': 'x', 'v': 'x', 'f': CASE WHEN len(shared) > 0 THEN 0.95 * scale ELSE 0.0::DOUBLE END, 'part': false}] END, recursive := true)
FROM (SELECT *, CASE WHEN lengths <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS scale FROM q)),
turned AS (SELECT name, choice, f, part, CASE WHEN len(u) <= len(v) THEN u ELSE v END AS u, CASE WHEN len(u) <= len(v) THEN v ELSE u END AS v FROM forms UNION ALL SELECT name, choice, f, part, v, u FROM forms WHERE part AND len(u) = len(v)),
folded AS (SELECT *, (1::HUGEINT << len(u)) - 1 AS every, list_transform(string_split(v, ''), lambda c: list_sum(list_transform(range(len(u)), lambda i: CASE WHEN u[i + 1] = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::HUGEINT) AS bits
FROM turned WHERE u <> '' AND f > 0),
w AS (SELECT name, choice, f, u, every, unnest(CASE WHEN part THEN list_transform(range(1 - len(u), len(v)), lambda i: bits[greatest(0, i) + 1 : i + len(u)]) ELSE [bits] END) AS bits FROM folded),
s AS (SELECT name, choice, max(f * (200.0::DOUBLE * (len(u) - bit_count(list_reduce(list_prepend(every, bits), lambda s, m: ((s + (s & m)) | (s - (s & m))) & every))) / (len(u) + len(bits)))) AS score FROM w GROUP BY ALL),
best AS (SELECT name, max(score) AS score, arg_min(choice, struct_pack(s := -score, c := choice)) AS choice FROM s GROUP BY name)"""


@query(f"""WITH {FUZZY_INPUT_SQL}, {SCORES_SQL} SELECT s_suppkey, x.name, CASE WHEN x.name IS NULL THEN 'missing' WHEN best.name IS NULL THEN 'exact' WHEN score >= 85 THEN 'fuzzy' ELSE 'unmatched' END AS match_method,
CASE WHEN x.name IS NULL THEN NULL WHEN best.name IS NULL THEN 100.0::DOUBLE ELSE round(score, 6) END AS match_score, CASE WHEN best.name IS NULL THEN x.name WHEN score >= 85 THEN choice END AS matched FROM x LEFT JOIN best ON best.name = x.name""")
def fuzzy_match(t: Tables) -> DataFrame:
    """Supplier names with a letter dropped or changed, against the names themselves."""
    k = F.col("s_suppkey") % 5
    typed = F.when(k == 0, F.col("s_name")).when(k == 1, F.expr("concat(substring(s_name, 1, 3), substring(s_name, 5))")).when(k == 2, F.lower("s_name")).when(k == 3, F.lit(None)).otherwise(F.concat(F.lit("no such place "), F.reverse("s_name")))
    x = t("supplier").select("s_suppkey", typed.alias("name"))
    choices = t("supplier").select(F.col("s_name").alias("choice"))
    return rounded(matching.fuzzy_best_match(x, "name", choices, "choice"))


@query("""WITH x AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat(' ', upper(n_name), ' LGA') END AS own, CASE WHEN c_custkey % 3 = 0 THEN 'elsewhere' ELSE n_name END AS other FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT CASE WHEN own IS NULL THEN 'unknown' WHEN other = 'elsewhere' THEN 'false' ELSE 'true' END AS agrees, count(*) AS n FROM x GROUP BY 1""")
def district_agreement(t: Tables) -> DataFrame:
    x = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    own = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit(" "), F.upper("n_name"), F.lit(" LGA")))
    other = F.when(F.col("c_custkey") % 3 == 0, "elsewhere").otherwise(F.col("n_name"))
    return x.groupBy(F.coalesce(names.agrees(own, other).cast("string"), F.lit("unknown")).alias("agrees")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def inner_join(t: Tables) -> DataFrame:
    return t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join(t: Tables) -> DataFrame:
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(t("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "total"), 2)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join_unmatched(t: Tables) -> DataFrame:
    return tables.unmatched(t("customer"), t("orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(t: Tables) -> DataFrame:
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT count(*) AS n_children, count(c_custkey) AS n_joined, count(*) - count(c_custkey) AS n_orphans FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment NOT IN ('FURNITURE', 'MACHINERY')")
def orphan_check(t: Tables) -> DataFrame:
    kept = t("customer").where(~F.col("c_mktsegment").isin("FURNITURE", "MACHINERY")).select("c_custkey")
    x = t("orders").select("o_custkey").join(kept, F.col("c_custkey") == F.col("o_custkey"), "left").agg(F.count("*").alias("n_children"), F.count("c_custkey").alias("n_joined"))
    return x.withColumn("n_orphans", F.col("n_children") - F.col("n_joined"))


@query("""WITH a AS (SELECT s_suppkey, round((s_suppkey % 100) * 0.1 + 3, 6)::DOUBLE AS lon, round((s_suppkey % 90) * 0.1 + 4, 6)::DOUBLE AS lat FROM supplier),
b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN lat WHEN s_suppkey % 9 = 1 THEN lon + 0.2 ELSE lon + 0.01 END AS lon2, CASE WHEN s_suppkey % 9 = 0 THEN lon ELSE lat END AS lat2 FROM a)
SELECT s_suppkey, round(lon, 6) AS lon, round(lat, 6) AS lat, round(lon2, 6) AS lon2, round(lat2, 6) AS lat2, abs(lon - lat2) <= 0.05 AND abs(lat - lon2) <= 0.05 AS looks_swapped FROM a JOIN b USING (s_suppkey) WHERE abs(lon - lon2) > 0.05 OR abs(lat - lat2) > 0.05""")
def residual_mismatch_join(t: Tables) -> DataFrame:
    a = t("supplier").select("s_suppkey", F.round((F.col("s_suppkey") % 100) * 0.1 + 3, 6).alias("lon"), F.round((F.col("s_suppkey") % 90) * 0.1 + 4, 6).alias("lat"))
    k = F.col("s_suppkey") % 9
    b = a.select("s_suppkey", F.when(k == 0, F.col("lat")).when(k == 1, F.col("lon") + 0.2).otherwise(F.col("lon") + 0.01).alias("lon2"), F.when(k == 0, F.col("lon")).otherwise(F.col("lat")).alias("lat2"))
    x = tables.mismatches(a, b, "s_suppkey", [("lon", "lon2"), ("lat", "lat2")])
    return rounded(x.withColumn("looks_swapped", coordinates.looks_swapped(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('source ', c_mktsegment) END AS population_source FROM customer")
def update_join(t: Tables) -> DataFrame:
    source = t("customer").where("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("source "), "c_mktsegment").alias("population_source"))
    return tables.update_from(t("customer").select("c_custkey"), source, "c_custkey", ["population_source"])


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS population_source FROM nation")
def add_column(t: Tables) -> DataFrame:
    x = t("nation").select("n_nationkey", "n_name")
    return x.withColumn("population_source", optional(x, "population_source"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS n_name FROM nation")
def update_from(t: Tables) -> DataFrame:
    """With a source key that no target row has."""
    source = t("nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("even").alias("n_name"))
    source = source.unionByName(source.select((F.col("n_nationkey") + 1000).alias("n_nationkey"), "n_name"))
    return tables.update_from(t("nation").select("n_nationkey", "n_name"), source, "n_nationkey", ["n_name"])


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def positional_join(t: Tables) -> DataFrame:
    s = t("supplier")
    a, b = s.select(F.col("s_suppkey").alias("row_index"), "s_suppkey", "s_name"), s.select(F.col("s_suppkey").alias("row_index"), "s_acctbal")
    return rounded(tables.positional_join(a, b).select("s_suppkey", "s_name", "s_acctbal"), 2)


NORMS = [("STANDARD", 0, 0, 2, 0, 0), ("SMALL", 0, 2, 3, 0, 0), ("MEDIUM", 1, 4, 4, 1, 0), ("LARGE", 2, 6, 3, 1, 0), ("ECONOMY", 3, 10, 2, 2, 1)]
NORM_COLUMNS = ["facility_type", "min_medical_officers", "min_nurses_midwives", "min_chews", "min_lab_scientists", "min_pharmacy_technicians"]
NORMS_SQL = f"norms AS (SELECT * FROM (VALUES {', '.join(map(str, NORMS))}) AS v({', '.join(NORM_COLUMNS)}))"


def norms(t: Tables) -> DataFrame:
    """Five rows; the last of a type would win."""
    return t.spark.createDataFrame(NORMS, ", ".join(f"{c} {'string' if i == 0 else 'int'}" for i, c in enumerate(NORM_COLUMNS)))


@query(f"WITH {NORMS_SQL} SELECT p_partkey, facility_type, min_chews FROM part LEFT JOIN norms ON facility_type = split_part(p_type, ' ', 1)")
def lookup_join(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.split("p_type", " ")[0].alias("facility_type")).join(F.broadcast(norms(t)), "facility_type", "left").select("p_partkey", F.when(F.col("min_chews").isNotNull(), F.col("facility_type")).alias("facility_type"), "min_chews")


STAFF = {"med_officers": "s_suppkey % 4", "nurses_midwives": "s_suppkey % 11", "chews": "s_suppkey % 5", "lab_scientists": "s_suppkey % 3", "pharm_techs": "s_suppkey % 2"}
TYPE = "CASE s_suppkey % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'ECONOMY' ELSE 'CLINIC' END"
STAFF_SQL = f"""fac AS (SELECT s_suppkey AS facility_id, {TYPE} AS facility_type, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_suppkey % 4 END AS med_officers, {', '.join(f'{v} AS {k}' for k, v in STAFF.items() if k != 'med_officers')} FROM supplier),
ad AS (SELECT fac.*, CASE WHEN norms.facility_type IS NULL THEN 'unknown_facility_type' WHEN med_officers IS NULL THEN 'no_personnel_record'
WHEN (min_medical_officers > 0 AND med_officers < min_medical_officers) OR (min_nurses_midwives > 0 AND nurses_midwives < min_nurses_midwives) OR (min_chews > 0 AND chews < min_chews) OR (min_lab_scientists > 0 AND lab_scientists < min_lab_scientists) OR (min_pharmacy_technicians > 0 AND pharm_techs < min_pharmacy_technicians) THEN 'inadequate' ELSE 'adequate' END AS adequacy_status FROM fac LEFT JOIN norms USING (facility_type))"""


def facility_adequacy(t: Tables) -> DataFrame:
    staff = [(F.when(F.col("s_suppkey") % 13 != 0, F.expr(v)) if k == "med_officers" else F.expr(v)).alias(k) for k, v in STAFF.items()]
    x = t("supplier").select(F.col("s_suppkey").alias("facility_id"), F.expr(TYPE).alias("facility_type"), *staff)
    x = x.join(F.broadcast(norms(t).withColumn("known", F.lit(True))), "facility_type", "left")
    return x.withColumn("adequacy_status", adequacy(F.col("known").isNotNull(), F.col("med_officers").isNotNull()))


@query(f"WITH {NORMS_SQL}, {STAFF_SQL} SELECT facility_id, facility_type, adequacy_status FROM ad")
def staffing_adequacy(t: Tables) -> DataFrame:
    return facility_adequacy(t).select("facility_id", "facility_type", "adequacy_status")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice * 2 - 1, 2) AS amount, o_totalprice > 1000 AS is_large, sqrt(abs(o_custkey)) > 10 AS far, CAST(o_totalprice > 1000 AS INT) AS large_int FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice IS NOT NULL AND o_totalprice > 1000")
def project_filter(t: Tables) -> DataFrame:
    x = t("orders").withColumn("is_large", F.col("o_totalprice") > 1000).where("o_orderstatus <> 'P' and o_totalprice is not null").where("is_large")
    return x.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 2 - 1, 2).alias("amount"), "is_large", (F.sqrt(F.abs("o_custkey")) > 10).alias("far"), F.col("is_large").cast("int").alias("large_int"))


@query("""SELECT s_suppkey AS facility_id, concat(s_name, ' LGA') AS raw_lga_name, CAST(NULL AS VARCHAR) AS raw_sen_district, CASE WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE 'clean' END AS lon_parse_method,
CASE WHEN s_suppkey % 3 = 0 THEN 'excluded_missing_or_unparseable' WHEN s_suppkey % 20 BETWEEN 3 AND 15 THEN 'included' ELSE 'excluded_out_of_bounds' END AS coord_status FROM supplier""")
def audit_log(t: Tables) -> DataFrame:
    s = t("supplier")
    lon = coordinates.parse_coordinate(F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 20).cast("string")))
    x = s.select("*", lon.alias("lon"))
    return x.select(F.col("s_suppkey").alias("facility_id"), F.concat("s_name", F.lit(" LGA")).alias("raw_lga_name"), optional(s, "sen_district").alias("raw_sen_district"), F.col("lon.method").alias("lon_parse_method"), coordinates.coord_status(F.col("lon.value"), F.lit(8.0)).alias("coord_status"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def union_recombine(t: Tables) -> DataFrame:
    """Keys that occur once and the first row of the others, brought together again."""
    x = tables.flag_duplicates(t("orders").select("o_custkey", "o_orderkey"), "o_custkey")
    first = tables.first_per_key(x.where("is_duplicate"), ["o_custkey"], F.col("o_orderkey"))
    return x.where("not is_duplicate").unionByName(first).select("o_custkey", "o_orderkey")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def table_scan(t: Tables) -> DataFrame:
    """SQL text over registered views."""
    t("customer").createOrReplaceTempView("gapwise_customer")
    t("nation").createOrReplaceTempView("gapwise_nation")
    return t.spark.sql("SELECT n_name, count(*) AS n FROM gapwise_customer JOIN gapwise_nation ON n_nationkey = c_nationkey GROUP BY n_name")


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def temp_view(t: Tables) -> DataFrame:
    t("region").select("r_regionkey", F.upper("r_name").alias("r_name")).createOrReplaceTempView("gapwise_region")
    return t.spark.table("gapwise_region")


@query("""WITH x AS (SELECT c_custkey, CAST(480000 + c_custkey * 37 AS VARCHAR) AS label FROM customer), s AS (SELECT *, list_sum([CAST(substring(label, length(label) - i, 1) AS INTEGER) * (i % 6 + 2) for i in range(0, length(label))]) AS total FROM x)
SELECT c_custkey, label || '-' || CASE (11 - total % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - total % 11) % 11 AS VARCHAR) END AS label FROM s""")
def specimen_labels(t: Tables) -> DataFrame:
    """Labels with their check digit."""
    label = (F.col("c_custkey") * 37 + 480_000).cast("string")
    return t("customer").select("c_custkey", F.concat(label, F.lit("-"), rules.check_digit(label)).alias("label"))
