"""Coordinates that arrive as free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import strip

#: Degrees, minutes, seconds and a hemisphere in capitals, with straight or curly quotes; seconds such as .5 or 5. are numbers.
DMS = "^\\s*(\\d+)°\\s*(\\d+)['’]\\s*(\\d+\\.?\\d*|\\.\\d+)[\"”]\\s*([NSEW])\\s*$"
#: What both engines read as a number; keeps out 7d, 1_0 and the like.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Closed box that a usable point lies in.
LON, LAT = (2.5, 15.0), (4.0, 14.0)
#: What ``coord_status`` gives.
STATUSES = ["included", "excluded_missing_or_unparseable", "excluded_out_of_bounds"]


def dms_to_decimal(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, DMS, i)
    value = part(1).cast("double") + part(2).cast("double") / 60 + part(3).cast("double") / 3600
    return F.when(c.rlike(DMS), F.when(part(4).isin("S", "W"), -value).otherwise(value))


def fix_comma_decimal(c: Column) -> Column:
    """``7,908,017`` is 7.908017: the first group is whole, the rest are decimals. Groups may be empty: ``7,908,`` and ``,908`` are read."""
    t = strip(c)
    value = F.concat(F.substring_index(t, ",", 1), F.lit("."), F.regexp_replace(F.regexp_replace(t, "^[^,]*,", ""), ",", "")).try_cast("double")
    return F.when(t.rlike(r"^\+?(?=.*\d)\d*(,\d*)+$") & (value > 0) & (value < 180), value)


def parse_coordinate(c: Column) -> Column:
    """struct(value, method); method is missing, dms, comma_decimal, clean or unparseable."""
    t = strip(c)
    found = lambda v, name: F.when(v.isNull(), F.struct(F.lit(None).cast("double").alias("value"), F.lit("unparseable").alias("method"))).otherwise(F.struct(v.alias("value"), F.lit(name).alias("method")))
    return (
        F.when(c.isNull() | (t == ""), F.struct(F.lit(None).cast("double").alias("value"), F.lit("missing").alias("method")))
        .when(t.contains("°"), found(dms_to_decimal(t), "dms"))
        .when(t.contains(","), found(fix_comma_decimal(t), "comma_decimal"))
        .otherwise(found(F.when(t.rlike(NUMBER), t.try_cast("double")), "clean"))
    )


def coord_status(lon: Column, lat: Column, lon_box=LON, lat_box=LAT) -> Column:
    return (
        F.when(lon.isNull() | lat.isNull(), "excluded_missing_or_unparseable")
        .when(~(lon.between(*lon_box) & lat.between(*lat_box)), "excluded_out_of_bounds")
        .otherwise("included")
    )


def looks_swapped(lon: Column, lat: Column, lon2: Column, lat2: Column, within: float = 0.05) -> Column:
    """Whether one source has the axes of the other exchanged."""
    return (F.abs(lon - lat2) <= within) & (F.abs(lat - lon2) <= within)
