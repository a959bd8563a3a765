"""GPS tracks: defects of fixes, speeds, gaps and sessions, for tracks of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coordinates import LAT, LON
from ..functions.geo import haversine_km
from ..shared import cut


def _in_box(lon: Column, lat: Column, lon_box: tuple, lat_box: tuple) -> Column:
    return F.coalesce(lon.between(*lon_box) & lat.between(*lat_box), F.lit(False))


def track_flags(fixes: DataFrame, track: str, ts: str, order: str, lon: str, lat: str, gap_seconds: float = 300.0, max_kmh: float = 150.0, lon_box: tuple = LON, lat_box: tuple = LAT) -> DataFrame:
    """``fixes`` with defect, lon_clean, lat_clean, seconds, km, kmh, too_fast and session.

    defect: ``no_time``, ``no_place``, ``zero`` (0, 0), ``swapped`` (outside the
    box, but inside it with axes exchanged; they are exchanged back), ``outside``
    or null. Fixes without defect and swapped ones are good. A good fix is
    measured against the good fix before it in its track, by time and then
    ``order``: seconds, km, kmh (null where no time passed) and whether that is
    over ``max_kmh``. A session ends where over ``gap_seconds`` pass; sessions
    count from 1 in each track. Other fixes have nulls there. A null track is a
    track.

    Fixes are sorted by track and time into ranges of about equal size, so that
    one long track is many ranges and tasks. Each range is scanned by itself;
    the last good fix and the number of sessions before it come from the ranges
    before, of which a track has a row each. Only fixes that agree in track,
    time and ``order`` cannot be told apart and stay together.
    """
    spark = fixes.sparkSession
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    defect = (
        F.when(F.col(ts).isNull(), "no_time")
        .when(x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y), "no_place")
        .when((x == 0) & (y == 0), "zero")
        .when(_in_box(x, y, lon_box, lat_box), None)
        .when(_in_box(y, x, lon_box, lat_box), "swapped")
        .otherwise("outside")
    )
    swapped = F.coalesce(F.col("__defect") == "swapped", F.lit(False))
    good = F.col("__defect").isNull() | swapped
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fixes.withColumn("__defect", defect).withColumns({"__x": F.when(good, F.when(swapped, y).otherwise(x)), "__y": F.when(good, F.when(swapped, x).otherwise(y)), "__t": F.unix_micros(F.col(ts).cast("timestamp"))})
    rows = cut(rows.repartitionByRange(n, track, "__t", order).withColumn("__range", F.spark_partition_id()))

    key = ["__range", track]
    at = F.struct(F.col("__t").alias("t"), F.col(order).alias("o"))
    fix = F.when(good, F.struct(F.col("__t").alias("t"), F.col("__x").alias("x"), F.col("__y").alias("y")))
    sort = [F.asc_nulls_first("__t"), F.asc_nulls_first(order)]
    before = Window.partitionBy(*key).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy(*key).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(track).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a track

    def carried(of: DataFrame, name: str, value: Column, over: Column) -> DataFrame:
        sums = of.groupBy(*key).agg(value.alias("v")).select(*key, over.alias(name))
        return sums.withColumnsRenamed({c: f"{c}__" for c in key})

    def met(of: DataFrame, sums: DataFrame) -> DataFrame:
        return of.join(sums, (of["__range"] == sums["__range__"]) & of[track].eqNullSafe(sums[f"{track}__"])).drop(*[f"{c}__" for c in key])

    last = carried(rows, "__carried", F.max_by(fix, F.when(good, at)), F.last("v", True).over(earlier))
    rows = met(rows.withColumn("__prev", F.last(fix, True).over(before)), last).withColumn("__prev", F.coalesce("__prev", "__carried"))
    seconds = F.when(good, (F.col("__t") - F.col("__prev.t")) / 1e6)
    starts = good & (F.col("__prev").isNull() | (seconds > gap_seconds))
    counts = carried(rows, "__sessions", F.count_if(starts), F.coalesce(F.sum("v").over(earlier), F.lit(0)))
    rows = met(rows.withColumn("__own", F.count_if(starts).over(to_here)), counts)
    km = F.when(good & F.col("__prev").isNotNull(), haversine_km(F.col("__prev.x"), F.col("__prev.y"), F.col("__x"), F.col("__y")))
    kmh = F.when(seconds > 0, km / (seconds / 3600))
    return rows.select(
        *fixes.columns,
        F.col("__defect").alias("defect"),
        F.col("__x").alias("lon_clean"),
        F.col("__y").alias("lat_clean"),
        seconds.alias("seconds"),
        km.alias("km"),
        kmh.alias("kmh"),
        (kmh > max_kmh).alias("too_fast"),
        F.when(good, F.col("__sessions") + F.col("__own")).alias("session"),
    )
