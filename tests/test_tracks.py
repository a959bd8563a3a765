"""Flags of GPS fixes against a plain walk along each track."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gapwise.operators import tracks

BEGAN = datetime(2024, 3, 1, 8)


def km(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def walk(rows, gap, fast):
    inside = lambda x, y: 2.5 <= x <= 15 and 4 <= y <= 14
    out, last = {}, {}
    for i, track, t, x, y in sorted(rows, key=lambda r: (r[2] is not None, r[2] or BEGAN, r[0])):
        if t is None:
            d = "no_time"
        elif x is None or y is None:
            d = "no_place"
        elif x == 0 and y == 0:
            d = "zero"
        else:
            d = None if inside(x, y) else "swapped" if inside(y, x) else "outside"
        if d not in (None, "swapped"):
            out[i] = (d, None, None, None, None)
            continue
        here = (y, x) if d else (x, y)
        before = last.get(track)
        s = (t - before[0]).total_seconds() if before else None
        way = km(before[1], here) if before else None
        speed = way / (s / 3600) if s else None
        session = 1 if before is None else before[2] + (s > gap)
        out[i] = (d, s, None if way is None else round(way, 9), None if speed is None else speed > fast, session)
        last[track] = (t, here, session)
    return out


def made(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for track, n in [("hot", 4000), ("stub", 11), (None, 300), ("one", 1), ("b", 500)]:
        t, x, y = BEGAN, 3.3, 9.0
        for _ in range(n):
            t += timedelta(seconds=rng.choice([0, 30, 60, 60, 60, 61, 900 if rng.random() < 0.1 else 60]))
            x, y = x + rng.uniform(-0.003, 0.003), y + rng.uniform(-0.003, 0.003)
            place = rng.choices([(x, y), (0.0, 0.0), (y, x), (3.0, 80.0), (None, y), (x + 0.2, y), (y - 9 + 3.0, x)], [90, 2, 2, 1, 1, 2, 2])[0]
            rows.append((i, track, None if rng.random() < 0.01 else t, *place))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", ["1", "16"])
def test_flags_are_a_walk(spark, ranges):
    rows = made(4)
    fixes = spark.createDataFrame(rows, "i long, track string, t timestamp, lon double, lat double")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = tracks.track_flags(fixes, "track", "t", "i", "lon", "lat", 300, 100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows) and {r.i: (r.defect, r.seconds, r.km and round(r.km, 9), r.too_fast, r.session) for r in got} == {k: v[:2] + (v[2] and v[2],) + v[3:] for k, v in walk(rows, 300, 100).items()}
    assert {r.defect for r in got} >= {None, "no_time", "no_place", "zero", "swapped", "outside"}


def test_one_long_track_is_many_ranges(spark):
    n = 300_000
    fixes = spark.range(n).select("id", F.lit("hot").alias("track"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60 + F.floor(F.col("id") / 1000) * 3600).alias("t"), (5.0 + F.col("id") % 7 * 0.001).alias("lon"), F.lit(9.0).alias("lat"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = tracks.track_flags(fixes, "track", "t", "id", "lon", "lat")
        right = F.col("session") == F.floor(F.col("id") / 1000) + 1
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
        assert tuple(out.agg(F.count("*"), F.count_if(right)).first()) == (n, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < n / 2


def test_no_fixes(spark):
    fixes = spark.createDataFrame([], "i long, track string, t timestamp, lon double, lat double")
    assert tracks.track_flags(fixes, "track", "t", "i", "lon", "lat").count() == 0
