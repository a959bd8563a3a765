"""Interviewer-level data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import share
from .describe import quantiles, with_global


def outcome_zscores(rows: DataFrame, by: str, y: str, limit: float = 2.0) -> DataFrame:
    """(mean_i - p) / sqrt(p (1 - p) / n_i) by interviewer, with p over all rows; is_outlier beyond ``limit``.

    Rows without an interviewer have no row here but are part of p.
    """
    x = with_global(rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(y).alias("n"), F.avg(y).alias("mean")), rows.agg(F.avg(y).alias("p")))
    z = F.try_divide(F.col("mean") - F.col("p"), F.sqrt(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("n"))))
    return x.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs("z") > limit, F.lit(False)))


def duration_stats(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Mean, least, most and number of non-null durations by interviewer, with the exact median of all."""
    own = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    return own.withColumn("median_all", F.lit(quantiles(rows, x, [0.5])[0]).cast("double"))


def below_quantile(rows: DataFrame, x: str, q: float = 0.05) -> DataFrame:
    """Rows under the exact ``q`` quantile (linear interpolation) of ``x``."""
    return rows.withColumn("cutoff", F.lit(quantiles(rows, x, [q])[0]).cast("double")).where(F.col(x) < F.col("cutoff"))


def fieldwork_rollup(log: DataFrame, by: str, attempted: str, completed: str, duration: str, checked: str, verified: str, yes: str = "Yes") -> DataFrame:
    """Days, mean of daily completion rates, mean duration, and shares of Yes with missing as No."""
    return log.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("days"),
        F.avg(F.try_divide(F.col(completed), F.col(attempted))).alias("mean_completion_rate"),
        F.avg(duration).alias("mean_duration"),
        (100 * share(F.col(checked) == yes)).alias("pct_spot_checked"),
        (100 * share(F.col(verified) == yes)).alias("pct_gps_verified"),
    )


def missingness(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Share of missing ``x`` in %, by group, most first."""
    out = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), (100 * F.avg(F.col(x).isNull().cast("double"))).alias("pct_missing"))
    return out.orderBy(F.desc_nulls_last("pct_missing"), F.asc_nulls_last(by))
