"""Coverage survey and interviewer checks. Stratum: region; cluster: nation; household: customer; child: order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import dose
from ..operators import describe, qa, survey
from .base import Tables, query, rounded

RESULT = "CASE c_mktsegment WHEN 'FURNITURE' THEN 'Vacant' WHEN 'MACHINERY' THEN 'Refused' ELSE 'Completed' END"
CARD = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Yes' WHEN '5-LOW' THEN NULL ELSE 'No' END"
CARE = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Yes' ELSE 'No' END"


def frame(t: Tables) -> DataFrame:
    n = t("nation")
    return n.select(F.col("n_nationkey").alias("cluster_id"), F.col("n_regionkey").alias("stratum"), (0.1 + 0.01 * F.col("n_nationkey")).alias("p1"), F.lit(20.0).alias("selected"), (60.0 + F.col("n_nationkey")).alias("listed"))


def households(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("household_id"), F.col("c_nationkey").alias("cluster_id"), F.expr(RESULT).alias("result"))


def weights(t: Tables) -> DataFrame:
    f = frame(t)
    return survey.design_weights(households(t), f).join(f.select("cluster_id", "stratum"), "cluster_id")


def children(t: Tables) -> DataFrame:
    seen = F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")
    return t("orders").select(F.col("o_orderkey").alias("child_id"), F.col("o_custkey").alias("household_id"), dose(seen, F.expr(CARD), F.expr(CARE)).alias("dose"))


def analysed(t: Tables) -> DataFrame:
    """Children of completed households whose dose is known."""
    c = children(t).where(F.col("dose").isNotNull()).withColumn("dose_yes", (F.col("dose") == "Yes").cast("int"))
    return c.join(weights(t).where("result = 'Completed'"), "household_id")


HOUSEHOLDS_SQL = f"""
hh AS (SELECT c_custkey AS household_id, c_nationkey AS cluster_id, {RESULT} AS result FROM customer),
adj AS (SELECT cluster_id, sum(CASE WHEN result <> 'Vacant' THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN result = 'Completed' THEN 1.0 ELSE 0 END), 0) AS nonresponse_adj FROM hh GROUP BY 1),
w AS (SELECT hh.*, n_regionkey AS stratum, 20.0::DOUBLE / (60 + n_nationkey) AS p2, 1.0::DOUBLE / ((0.1::DOUBLE + 0.01::DOUBLE * n_nationkey) * (20.0::DOUBLE / (60 + n_nationkey))) AS design_weight, nonresponse_adj::DOUBLE AS nonresponse_adj FROM hh JOIN nation ON n_nationkey = cluster_id JOIN adj USING (cluster_id)),
wf AS (SELECT *, CASE WHEN result = 'Completed' THEN design_weight * nonresponse_adj END AS final_weight FROM w)"""
DOSE_SQL = f"CASE WHEN o_orderstatus = 'F' THEN {CARD} ELSE {CARE} END"
ANALYSED_SQL = f"""{HOUSEHOLDS_SQL},
ch AS (SELECT o_orderkey, o_custkey AS household_id, {DOSE_SQL} AS dose FROM orders),
a AS (SELECT CASE WHEN dose = 'Yes' THEN 1 ELSE 0 END AS y, final_weight AS fw, stratum, cluster_id FROM ch JOIN wf USING (household_id) WHERE result = 'Completed' AND dose IS NOT NULL)"""


@query(f"""WITH {ANALYSED_SQL},
d AS (SELECT 'ALL' AS domain, * FROM a UNION ALL SELECT CAST(stratum AS VARCHAR), * FROM a),
c AS (SELECT domain, stratum, cluster_id, sum(fw * y) AS num, sum(fw) AS den, count(*) AS n, sum(y) AS sy FROM d GROUP BY 1, 2, 3),
r AS (SELECT *, sum(num) OVER (PARTITION BY domain) / sum(den) OVER (PARTITION BY domain) AS r, sum(den) OVER (PARTITION BY domain) AS wt FROM c),
e AS (SELECT *, num - r * den AS e, count(*) OVER (PARTITION BY domain, stratum) AS nh FROM r),
f AS (SELECT *, e - avg(e) OVER (PARTITION BY domain, stratum) AS off FROM e),
g AS (SELECT domain, sum(n) AS n, any_value(r) AS r, sqrt(sum(CASE WHEN nh > 1 THEN nh * 1.0::DOUBLE / (nh - 1) * off * off ELSE 0 END)) / any_value(wt) AS se, sum(sy) AS sy FROM f GROUP BY 1)
SELECT domain, CAST(n AS BIGINT) AS n, round(r, 6) AS coverage, round(se, 6) AS se, round(se * se / (r * (1 - r) / n), 4) AS deff, round(n / (se * se / (r * (1 - r) / n)), 2) AS ess, round(r - 1.96 * se, 6) AS ci_low, round(r + 1.96 * se, 6) AS ci_high, round(sy * 1.0::DOUBLE / n, 6) AS unweighted FROM g""")
def survey_coverage_by_stratum(t: Tables) -> DataFrame:
    return rounded(survey.ratio_estimates(analysed(t), "dose_yes", "final_weight", "stratum", "cluster_id"), deff=4, ess=2)


@query(f"WITH {HOUSEHOLDS_SQL} SELECT household_id, result, round(p2, 6) AS p2, round(design_weight, 6) AS design_weight, round(nonresponse_adj, 6) AS nonresponse_adj, round(final_weight, 6) AS final_weight FROM wf")
def design_weights(t: Tables) -> DataFrame:
    return rounded(weights(t).select("household_id", "result", "p2", "design_weight", "nonresponse_adj", "final_weight"))


@query(f"SELECT coalesce({DOSE_SQL}, 'missing') AS dose, count(*) AS n, count(*) FILTER (WHERE ({DOSE_SQL}) IS NULL) AS n_missing FROM orders GROUP BY 1")
def dose_indicator(t: Tables) -> DataFrame:
    return children(t).groupBy(F.coalesce("dose", F.lit("missing")).alias("dose")).agg(F.count("*").alias("n"), F.count_if(F.col("dose").isNull()).alias("n_missing"))


@query(f"WITH {ANALYSED_SQL} SELECT round(sum(fw * y) / sum(fw), 6) AS weighted, round(avg(y), 6) AS unweighted, round(sum(fw * y) / sum(fw) - avg(y), 6) AS difference FROM a")
def weighted_vs_unweighted(t: Tables) -> DataFrame:
    return rounded(survey.weighting_effect(analysed(t), "dose_yes", "final_weight"))


@query("SELECT count(*) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_quantity, l_returnflag FROM lineitem)) AS n_after, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_quantity, l_returnflag FROM lineitem)) AS n_dropped FROM lineitem")
def dedupe_rows(t: Tables) -> DataFrame:
    return survey.dedupe_rows(t("lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))[1]


EVENT = "CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END"


@query(f"""WITH p AS (SELECT avg({EVENT}) AS p FROM events), g AS (SELECT user_id, count(*) AS n, avg({EVENT}) AS mean FROM events GROUP BY 1)
SELECT user_id, n, round(mean, 6) AS mean, round(p, 6) AS p, round((mean - p) / nullif(sqrt(p * (1 - p) / n), 0), 6) AS z, coalesce(abs((mean - p) / nullif(sqrt(p * (1 - p) / n), 0)) > 2, false) AS is_outlier FROM g, p""")
def interviewer_zscore(t: Tables) -> DataFrame:
    return rounded(qa.outcome_zscores(t("events").withColumn("y", F.expr(EVENT).cast("double")), "user_id", "y"))


@query("""SELECT user_id, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n, round((SELECT median(value) FROM events), 6) AS median_all FROM events GROUP BY 1""")
def duration_stats(t: Tables) -> DataFrame:
    return rounded(qa.duration_stats(t("events"), "user_id", "value"))


@query("SELECT event_id, round(value, 6) AS value, round((SELECT quantile_cont(value, 0.05) FROM events), 6) AS cutoff FROM events WHERE value < (SELECT quantile_cont(value, 0.05) FROM events)")
def bottom_quantile(t: Tables) -> DataFrame:
    return rounded(qa.below_quantile(t("events").select("event_id", "value"), "value"))


@query("""SELECT user_id, count(*) AS days, round(avg((event_id % 17) * 1.0::DOUBLE / nullif(event_id % 19, 0)), 6) AS mean_completion_rate, round(avg(value), 6) AS mean_duration,
round(100 * avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS pct_spot_checked, round(100 * avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_gps_verified FROM events GROUP BY 1""")
def fieldwork_rollup(t: Tables) -> DataFrame:
    log = t("events").select("user_id", (F.col("event_id") % 19).alias("attempted"), (F.col("event_id") % 17).alias("completed"), "value", F.when(F.col("event_type") == "click", "Yes").otherwise("No").alias("checked"), F.when(F.col("event_id") % 3 == 0, "Yes").alias("verified"))
    return rounded(qa.fieldwork_rollup(log, "user_id", "attempted", "completed", "value", "checked", "verified"))


@query(f"SELECT o_custkey % 50 AS interviewer, count(*) AS n, round(100 * avg(CASE WHEN ({DOSE_SQL}) IS NULL THEN 1.0 ELSE 0.0 END), 6) AS pct_missing FROM orders GROUP BY 1")
def missingness_by_group(t: Tables) -> DataFrame:
    return rounded(qa.missingness(children(t).withColumn("interviewer", F.col("household_id") % 50), "interviewer", "dose"))


@query("SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(max(l_extendedprice), 4) AS max FROM lineitem")
def describe_numeric(t: Tables) -> DataFrame:
    return rounded(describe.describe(t("lineitem"), "l_extendedprice"), 4)


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return describe.value_counts(t("orders"), "o_orderpriority")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def category_breakdown(t: Tables) -> DataFrame:
    return rounded(describe.category_breakdown(t("orders"), "o_orderpriority", "o_totalprice"), 2)


@query("SELECT user_id, count(DISTINCT event_type) AS n_distinct, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types FROM events GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    x = describe.distinct_sorted(t("events"), ["user_id"], "event_type")
    return x.select("user_id", "n_distinct", F.array_join("values", ",").alias("event_types"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'click') AS n_clicks, count(*) FILTER (WHERE value > 50) AS n_high, count(*) FILTER (WHERE CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END IS NULL) AS n_null FROM events")
def conditional_counts(t: Tables) -> DataFrame:
    return describe.conditional_counts(t("events"), n_clicks=F.col("event_type") == "click", n_high=F.col("value") > 50, n_null=F.when(F.col("event_id") % 7 != 0, F.col("event_id")).isNull())


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(l_quantity) AS n_quantity, round(avg(l_quantity), 6) AS mean_quantity, round(100 * avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS pct_discounted FROM lineitem GROUP BY 1, 2""")
def group_means(t: Tables) -> DataFrame:
    x = t("lineitem").groupBy("l_returnflag", "l_linestatus")
    return rounded(x.agg(F.count("*").alias("n_rows"), F.count("l_quantity").alias("n_quantity"), F.avg("l_quantity").alias("mean_quantity"), (100 * F.avg((F.col("l_discount") > 0.05).cast("double"))).alias("pct_discounted")))


@query("SELECT round(min(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 2) AS masked_min, round(max(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 2) AS masked_max, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS masked_sum, round(sum(l_quantity), 2) AS sum_all, count(*) AS n_rows FROM lineitem")
def conditional_agg(t: Tables) -> DataFrame:
    x, mask = t("lineitem"), F.col("l_returnflag") == "R"
    price = describe.masked(x, mask, "l_extendedprice").select("masked_min", "masked_max")
    return rounded(describe.with_global(price, describe.masked(x, mask, "l_quantity").select("masked_sum", "sum_all", "n_rows")), 2)


@query("SELECT count(*) AS n_before, count(*) FILTER (WHERE l_quantity > 25) AS n_after, count(*) - count(*) FILTER (WHERE l_quantity > 25) AS n_dropped FROM lineitem")
def row_counts(t: Tables) -> DataFrame:
    x = t("lineitem").agg(F.count("*").alias("n_before"), F.count_if(F.col("l_quantity") > 25).alias("n_after"))
    return x.withColumn("n_dropped", F.col("n_before") - F.col("n_after"))
