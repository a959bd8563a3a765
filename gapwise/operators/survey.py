"""Design-weighted estimates for a stratified two-stage cluster sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import differs, total
from ..shared import cut

ALL = "ALL"


def design_weights(households: DataFrame, frame: DataFrame, cluster: str = "cluster_id", result: str = "result", completed: str = "Completed", vacant: str = "Vacant") -> DataFrame:
    """Households with p2, design_weight, nonresponse_adj and final_weight.

    ``frame`` has one row a cluster: its id, p1 (stage-1 probability), selected
    and listed households. The adjustment of a cluster is its eligible (not
    vacant; an unknown result is eligible) by its completed households. Only
    completed households have a final weight; a division by zero gives null.
    """
    p2 = F.try_divide(F.col("selected"), F.col("listed"))
    eligible, done = differs(F.col(result), vacant), F.col(result).eqNullSafe(F.lit(completed))
    adj = households.groupBy(cluster).agg(F.count_if(eligible).alias("eligible"), F.count_if(done).alias("completed"))
    adj = adj.select(cluster, F.try_divide(F.col("eligible"), F.col("completed")).alias("nonresponse_adj"))
    out = households.join(frame.select(cluster, "p1", "selected", "listed"), cluster, "left").withColumn("p2", p2)
    out = out.withColumn("design_weight", F.try_divide(F.lit(1.0), F.col("p1") * F.col("p2"))).join(adj, cluster, "left")
    return out.withColumn("final_weight", F.when(F.col(result) == completed, F.col("design_weight") * F.col("nonresponse_adj")))


def ratio_estimates(rows: DataFrame, y: str, w: str, stratum: str, cluster: str, z: float = 1.96) -> DataFrame:
    """Weighted mean of ``y`` with ultimate-cluster standard errors, for each stratum and for ALL.

    Rows are read once: they are summed by stratum and cluster, and what is left
    (a row a cluster) gives every domain. A cluster's residual is its weighted
    sum less the domain's ratio times its weights; strata with one cluster add no
    variance; clusters without rows in a domain are not counted. Rows without a
    weight are in neither sum but count in n.
    """
    c = rows.groupBy(F.col(stratum).alias("stratum"), F.col(cluster).alias("cluster")).agg(total(F.col(w) * F.col(y)).alias("num"), total(F.col(w)).alias("den"), F.count("*").alias("n"), total(F.col(y).cast("double")).alias("sum_y"))
    c = cut(c).withColumn("domain", F.explode(F.array(F.lit(ALL), F.col("stratum").cast("string"))))
    # sums with partial aggregation, joined back: ALL is never one task's window
    d = c.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("num").alias("y"), F.sum("den").alias("weights"), F.sum("sum_y").alias("sum_y"))
    d = d.withColumn("coverage", F.try_divide("y", "weights"))
    same = lambda *names: reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in names])
    e = c.join(d.select(F.col("domain").alias("__domain"), "coverage"), same("domain")).withColumn("e", F.col("num") - F.col("coverage") * F.col("den")).select("domain", "stratum", "e")
    mean = e.groupBy(F.col("domain").alias("__domain"), F.col("stratum").alias("__stratum")).agg(F.avg("e").alias("mean"), F.count("*").alias("n_h"))
    off = e.join(mean, same("domain", "stratum")).withColumn("off", F.col("e") - F.col("mean"))
    part = F.when(F.col("n_h") > 1, F.col("n_h") / (F.col("n_h") - 1) * F.col("off") * F.col("off")).otherwise(0.0)
    d = d.join(off.groupBy(F.col("domain").alias("__domain")).agg(F.sum(part).alias("var")), same("domain"), "left")
    d = d.withColumn("se", F.try_divide(F.sqrt("var"), F.col("weights")))
    srs = F.try_divide(F.col("coverage") * (1 - F.col("coverage")), F.col("n"))
    d = d.withColumn("deff", F.try_divide(F.col("se") * F.col("se"), srs))
    return d.select("domain", F.col("n").cast("long").alias("n"), "coverage", "se", "deff", F.try_divide(F.col("n"), F.col("deff")).alias("ess"), (F.col("coverage") - z * F.col("se")).alias("ci_low"), (F.col("coverage") + z * F.col("se")).alias("ci_high"), F.try_divide(F.col("sum_y"), F.col("n")).alias("unweighted"))


def weighting_effect(rows: DataFrame, y: str, w: str) -> DataFrame:
    """One row: weighted and unweighted mean and their difference."""
    r = rows.agg(F.try_divide(F.sum(F.col(w) * F.col(y)), F.sum(w)).alias("weighted"), F.avg(F.col(y).cast("double")).alias("unweighted"))
    return r.withColumn("difference", F.col("weighted") - F.col("unweighted"))


def dedupe_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct rows, one row of n_before, n_after, n_dropped)."""
    out = rows.dropDuplicates()
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_before"), F.count("*").alias("n_after"))
    return out, counts.withColumn("n_dropped", F.col("n_before") - F.col("n_after"))
