"""Summaries of columns and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_global(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``one``, an aggregate without keys: exactly one row, so it is broadcast."""
    return rows.crossJoin(F.broadcast(one))


#: Values that the last pass of a selection may bring to the driver, and the error of the sketch that narrows the others.
AT_HAND, ERROR = 50_000, 0.001


def order_statistics(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values at ``ranks`` (from 0) of the ``n`` doubles of the one column ``x``.

    A quantile sketch, merged from all tasks, gives two values that enclose each
    rank; a count over the same column says how much lies below, on and between
    them. What lies between is a few thousandths of the rows, and is collected or
    narrowed again, so no task and no driver holds all distinct values.
    """
    if n <= AT_HAND:
        found = sorted(r.x for r in values.collect())
        return {k: found[k] for k in ranks}
    at = [k / (n - 1) for k in ranks]
    ends = values.approxQuantile("x", [q for a in at for q in (max(0.0, a - 2 * ERROR), min(1.0, a + 2 * ERROR))], ERROR)
    pairs = list(zip(ends[::2], ends[1::2]))
    x = F.col("x")
    counts = values.agg(*[F.count_if(c).alias(f"{name}{i}") for i, (a, b) in enumerate(pairs) for name, c in (("below", x < a), ("low", x == a), ("mid", (x > a) & (x < b)))]).first()
    out, some = {}, {}
    for i, (k, (a, b)) in enumerate(zip(ranks, pairs)):
        rest = k - counts[f"below{i}"]
        if rest < counts[f"low{i}"]:
            out[k] = a
        elif rest - counts[f"low{i}"] >= counts[f"mid{i}"]:
            out[k] = b
        else:
            some.setdefault((a, b, counts[f"mid{i}"]), []).append((k, rest - counts[f"low{i}"]))
    for (a, b, m), own in some.items():
        inner = order_statistics(values.where((x > a) & (x < b)), sorted({r for _, r in own}), m)
        out |= {k: inner[r] for k, r in own}
    return out


def quantiles(rows: DataFrame, x: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles of ``x`` with linear interpolation, in passes over the column; null and NaN are missing."""
    values = rows.select(F.col(x).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = values.count()
    if not n:
        return [None] * len(qs)
    at = [q * (n - 1) for q in qs]
    low = [int(a) for a in at]
    v = order_statistics(values, sorted({*low, *(min(k + 1, n - 1) for k in low)}), n)
    return [v[k] + (v[min(k + 1, n - 1)] - v[k]) * (a - k) if a > k else v[k] for a, k in zip(at, low)]


def describe(rows: DataFrame, x: str) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles, most. One row; the quartiles are found at once."""
    quartiles = [F.lit(v).cast("double").alias(name) for v, name in zip(quantiles(rows, x, [0.25, 0.5, 0.75]), ["p25", "p50", "p75"])]
    one = rows.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return one.select("count", "mean", "std", "min", *quartiles, "max")


def value_counts(rows: DataFrame, x: str) -> DataFrame:
    """Rows of each value but null, most first."""
    return rows.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("count")).orderBy(F.desc("count"), x)


def category_breakdown(rows: DataFrame, by: str, amount: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def conditional_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows fulfil each condition (null does not)."""
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def masked(rows: DataFrame, mask: Column, x: str) -> DataFrame:
    """Least, most and sum of ``x`` where ``mask`` holds, beside the sum of all."""
    v = F.when(mask, F.col(x))
    return rows.agg(F.min(v).alias("masked_min"), F.max(v).alias("masked_max"), F.sum(v).alias("masked_sum"), F.sum(x).alias("sum_all"), F.count("*").alias("n_rows"))


def distinct_sorted(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Number and sorted list of the distinct values of a group; for columns of few values."""
    return rows.groupBy(*by).agg(F.count_distinct(x).cast("long").alias("n_distinct"), F.sort_array(F.collect_set(x)).alias("values"))
