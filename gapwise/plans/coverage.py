"""Coverage survey, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import dose
from ..operators import qa, survey

KEYS = ["household_id", "cluster_id", "stratum_code"]


def weighted_children(households: DataFrame, children: DataFrame, frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analysed children with dose_yes and final_weight, orphans: children without a completed household).

    ``frame`` is the sampling frame; its selected rows must be one a cluster.
    Blocks of rows that were entered twice are dropped first.
    """
    h, c = households.dropDuplicates(), children.dropDuplicates()
    f = frame.where(F.lower(F.col("selected").cast("string")).isin("1", "1.0", "yes", "true")).select("cluster_id", F.col("stage1_selection_probability").alias("p1")).distinct()
    h = h.withColumns({"selected": F.col("stage2_households_selected"), "listed": F.col("stage2_households_listed")})
    # stage 2 counts stand on each household, so the frame takes them from there
    counts = h.groupBy("cluster_id").agg(F.max("selected").alias("selected"), F.max("listed").alias("listed"))
    w = survey.design_weights(h.drop("selected", "listed"), f.join(counts, "cluster_id"), "cluster_id", "result_of_visit")
    done = w.where("result_of_visit = 'Completed'").select(*KEYS, "interviewer_id", "final_weight")
    c = c.withColumn("dose", dose(F.col("vaccination_card_seen"), F.col("dose_recorded_on_card"), F.col("dose_reported_by_caregiver")))
    joined = c.join(done, KEYS)
    return joined.where("dose is not null").withColumn("dose_yes", (F.col("dose") == "Yes").cast("int")), c.join(done, KEYS, "left_anti")


def coverage(households: DataFrame, children: DataFrame, frame: DataFrame) -> DataFrame:
    """Coverage with standard errors, design effects and intervals, overall and by stratum."""
    analysed, _ = weighted_children(households, children, frame)
    return survey.ratio_estimates(analysed, "dose_yes", "final_weight", "stratum_code", "cluster_id")


def interviewer_checks(households: DataFrame, children: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """Four tables by interviewer. A missing dose counts as no here, unlike in ``coverage``."""
    h, c = households.dropDuplicates(), children.dropDuplicates()
    c = c.withColumn("dose", dose(F.col("vaccination_card_seen"), F.col("dose_recorded_on_card"), F.col("dose_reported_by_caregiver")))
    c = c.withColumn("dose_yes", F.when(F.col("dose").eqNullSafe(F.lit("Yes")), 1.0).otherwise(0.0))
    by = h.where("result_of_visit = 'Completed'").select("household_id", "interviewer_id")
    return {
        "zscores": qa.outcome_zscores(c.join(by, "household_id", "left"), "interviewer_id", "dose_yes"),
        "durations": qa.duration_stats(h, "interviewer_id", "interview_duration_min"),
        "fieldwork": qa.fieldwork_rollup(log, "interviewer_id", "households_attempted", "households_completed", "mean_interview_duration_min", "supervisor_spot_check", "gps_verified"),
        "missingness": qa.missingness(c.join(by, "household_id"), "interviewer_id", "dose"),
    }
