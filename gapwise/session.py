"""Session builder with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "gapwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; ``conf`` keys use ``__`` for dots.

    Shuffle partitions are left to the cluster's own setting: AQE coalesces
    small ones, and a large job needs more than any constant chosen here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
