"""Joins, updates and row selection with the data-frame rules spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; ties need a last column that tells rows apart."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")  # each task keeps one row a key before the shuffle


def top_per_group(rows: DataFrame, by: str, n: int, *order: Column, rank: str = "severity_rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; Spark limits each task before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= n)


def update_from(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` from the row of ``source`` with the same key; unmatched rows stay as they are.

    A missing column is added first. Of several source rows of a key the least is taken.
    """
    s = source.groupBy(key).agg(F.min(F.struct(*columns)).alias("__s"))
    out = target.join(s, key, "left")
    for c in columns:
        old = F.col(c) if c in target.columns else F.lit(None).cast(dict(source.dtypes)[c])
        out = out.withColumn(c, F.when(F.col("__s").isNotNull(), F.col(f"__s.{c}")).otherwise(old))
    return out.drop("__s")


def positional_join(left: DataFrame, right: DataFrame, index: str = "row_index") -> DataFrame:
    """Join two frames by a row index that both have; ValueError if their rows do not match one to one."""
    n = left.count()
    out = left.join(right, index)
    if not n == right.count() == out.count():
        raise ValueError("the two inputs differ in their rows")
    return out


def unmatched(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    return left.join(right.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def mismatches(a: DataFrame, b: DataFrame, key: str, pairs: list[tuple[str, str]], tolerance: float = 0.05) -> DataFrame:
    """Rows of one key whose values differ by more than ``tolerance`` on any of ``pairs``."""
    off = None
    for x, y in pairs:
        d = F.abs(F.col(x) - F.col(y)) > tolerance
        off = d if off is None else off | d
    return a.join(b, key).where(off)


def flag_duplicates(rows: DataFrame, key: str, flag: str = "is_duplicate") -> DataFrame:
    """Whether the key occurs more than once; counted before the join, so a hot key is no hot window."""
    n = rows.groupBy(key).agg((F.count("*") > 1).alias(flag))
    return rows.join(n.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def pick_by_rule(rows: DataFrame, key: str, trusted: Column, remark: Column, order: Column) -> DataFrame:
    """One row for each key: the only one the trusted source confirms, else one whose remark prefers it, else the first.

    Keys that are null are kept as they are; ``order`` is the row's place in its file.
    """
    n = F.count_if(trusted).over(Window.partitionBy(key))
    first = F.when((n == 1) & trusted, 0).when(F.when(n == 1, False).otherwise(remark), 1).otherwise(2)
    keyed = rows.where(F.col(key).isNotNull()).withColumns({"__first": first, "__order": order})
    keyed = first_per_key(keyed, [key], F.col("__first"), F.col("__order")).drop("__first", "__order")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def forward_fill(rows: DataFrame, columns: list[str], order: str, within: list[str] | None = None) -> DataFrame:
    """Blank cells take the last value above, in file order.

    Without ``within`` the order is that of one file and ``order`` is a number,
    the row's place. Rows are split into ranges that hold about as many rows
    each: their bounds are approximate quantiles of the places, read first and
    set in the plan as constants, so the range of a row is a function of its
    place alone, however the plan is run, and however far apart places lie. Each
    range is filled by itself and the last value of the ranges before is carried
    in, so no task sees all rows. A null place comes first.
    """
    if within:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least, bounds = rows.agg(F.min(order), F.percentile_approx(order, [(k + 1) / ranges for k in range(ranges - 1)] or [1.0], 100 * ranges)).first()
    bounds = F.array(*[F.lit(b).cast("double") for b in sorted(set(bounds or []))]) if bounds else F.array().cast("array<double>")
    place = F.col(order).cast("double")
    ranged = rows.withColumn("__range", F.coalesce(F.when(place.isNotNull(), F.size(F.filter(bounds, lambda b: b < place))), F.lit(-1)))
    w = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumns({f"__{c}": F.last(c, ignorenulls=True).over(w) for c in columns})
    last = ranged.groupBy("__range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce(F.col(order), F.lit(least)))).alias(c) for c in columns])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, ranges + 2 at most
    carried = last.select("__range", *[F.last(c, ignorenulls=True).over(before).alias(f"__carried_{c}") for c in columns])
    out = inside.join(F.broadcast(carried), "__range", "left")
    return out.select(*[F.coalesce(f"__{c}", f"__carried_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])
