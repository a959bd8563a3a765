"""Cutting lineage, checking sizes, and code for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions run on executors are pickled by reference, so the package must be
    importable there even where the repository is only on the driver's machine.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="gapwise-"), "gapwise_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(to)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint directory that Spark has, or spark.checkpoint.dir.

    Only a local session without either makes a folder of its own; on a cluster
    that would be a different folder on each machine, so there it is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        to = sc.getConf().get("spark.checkpoint.dir")
        if not to and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(to or tempfile.mkdtemp(prefix="gapwise-cp-"))
    return sc.getCheckpointDir()


def remove_later(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the application ends: a result may be read from it until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` with all it holds, for what nothing reads again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in ``shared_folder``, which goes when the application ends.

    The rows are wrapped anew because a checkpoint hands on the size estimates of
    the plan that it replaces, which grow without end over rounds of joins.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)._jdf
    rdd = kept.queryExecution().toRdd()
    while not rdd.getCheckpointFile().isDefined() and not rdd.dependencies().isEmpty():
        rdd = rdd.dependencies().head().rdd()
    if rdd.getCheckpointFile().isDefined():
        remove_later(spark, rdd.getCheckpointFile().get())
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def fits(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than one over."""
    return df.limit(most + 1).count() <= most
