"""Granularity predicates over two match points, as Columns.

A point has y_start, y_end, time_month, time_day and the four place levels; a null is unknown. A null year bound never
satisfies a time predicate; a null month, day or coarser place level agrees with anything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import LOCATION_GRANULARITIES, LOCATION_LEVELS, TIME_GRANULARITIES

#: Years in a unit of the coarse granularities.
UNIT = {"century": 100, "decade": 10, "year": 1, "month": 1, "day": 1}


def check_granularity(time: str, location: str) -> None:
    if time not in TIME_GRANULARITIES:
        raise ValueError(f"unknown time granularity {time!r}")
    if location not in LOCATION_GRANULARITIES:
        raise ValueError(f"unknown location granularity {location!r}")


def unit_of(year: Column, granularity: str) -> Column:
    """Number of the decade or century; floors, so that years before 0 have units of their own."""
    n = UNIT[granularity]
    return year if n == 1 else F.floor(year / float(n)).cast("int")


def alike(a: Column, b: Column) -> Column:
    """Equal, or unknown on a side."""
    return a.isNull() | b.isNull() | (a == b)


def part(side: str | Column, name: str) -> Column:
    """A column of a side, which is an alias or a struct."""
    return F.col(f"{side}.{name}") if isinstance(side, str) else side[name]


def time_condition(granularity: str, a: str | Column = "a", b: str | Column = "b") -> Column:
    if granularity == "none":
        return F.lit(True)
    if granularity not in UNIT:
        raise ValueError(f"unknown time granularity {granularity!r}")
    at = lambda side, c: unit_of(part(side, c), granularity)
    cond = (at(a, "y_start") <= at(b, "y_end")) & (at(b, "y_start") <= at(a, "y_end"))
    for c in {"month": ("time_month",), "day": ("time_month", "time_day")}.get(granularity, ()):
        cond = cond & alike(part(a, c), part(b, c))
    return cond


def location_condition(granularity: str, a: str | Column = "a", b: str | Column = "b") -> Column:
    """The level's equality comes first, as an equi-join key."""
    if granularity == "none":
        return F.lit(True)
    if granularity not in LOCATION_LEVELS:
        raise ValueError(f"unknown location granularity {granularity!r}")
    cond = part(a, granularity) == part(b, granularity)
    for level in LOCATION_LEVELS[: LOCATION_LEVELS.index(granularity)]:
        cond = cond & alike(part(a, level), part(b, level))
    return cond
