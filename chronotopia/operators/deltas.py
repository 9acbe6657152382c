"""Counts of pairs brought up to date when books come and go, without counting what stays.

What a change adds is the pairs of the new books with those that stay and among themselves; what it takes away is the same
of the books that go. Both are sums as in ``encounters.pair_count``, between two sets of points, and of the points that
stay only those are read that share a place with a changed book.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import check_granularity, unit_of
from . import encounters as E


def _few(points: DataFrame, time: str, location: str) -> DataFrame:
    """Distinct points by what the granularity reads, with their number ``m``."""
    own = points.filter("book_id IS NOT NULL")
    if location != "none":
        own = own.filter(F.col(location).isNotNull())
    if time == "none":
        own = own.withColumn("y_start", F.lit(0)).withColumn("y_end", F.lit(0))
    else:
        own = own.filter("y_start IS NOT NULL AND y_end IS NOT NULL").withColumns({c: unit_of(F.col(c), time) for c in ("y_start", "y_end")})
    place = [] if location == "none" else [location]
    return own.groupBy(*place, *E._wild(time, location), "y_start", "y_end").agg(F.count("*").alias("m"))


def between_count(a: DataFrame, b: DataFrame, time: str = "year", location: str = "city") -> DataFrame:
    """One row: n, the number of pairs of a point of ``a`` and one of ``b``, which have no book in common; without listing them."""
    check_granularity(time, location)
    place, wild = [] if location == "none" else [location], E._wild(time, location)
    few_a, few_b = _few(a, time, location), _few(b, time, location)
    if place:  # elsewhere they can't meet
        few_b = few_b.join(few_a.select(*place).distinct(), place, "left_semi")
    group = [*place, "known", *[f"w_{c}" for c in wild]]
    one, two = (E._meeting(few, wild, place).filter(role).select(*group, "y_start", "y_end", "m") for few, role in ((few_a, ~F.col("second")), (few_b, F.col("second"))))
    wide = lambda c: c.cast("decimal(38,0)")
    none = F.lit(0).cast("long")
    # What begins and ends in each year, of both sides.
    years = reduce(DataFrame.union, [
        rows.select(*group, F.col(at).alias("at"), *[(F.col("m") if k == n else none).alias(f"c{k}") for k in range(4)])
        for n, (rows, at) in enumerate(((one, "y_start"), (one, "y_end"), (two, "y_start"), (two, "y_end")))
    ])
    years = years.groupBy(*group, "at").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)])
    before = Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ended = lambda c: wide(F.coalesce(F.sum(c).over(before), none))
    years = years.withColumn("apart", wide(F.col("c2")) * ended("c1") + wide(F.col("c0")) * ended("c3"))
    sums = years.groupBy(*group).agg(F.sum("c0").alias("x"), F.sum("c2").alias("y"), F.sum("apart").alias("apart"))
    total = sums.agg(F.sum(wide(F.col("x")) * wide(F.col("y")) - F.col("apart")).alias("n"))
    if time != "none":
        # Each ends before the other begins: taken off twice above. One of the two ends before it begins.
        same = reduce(lambda p, q: p & q, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group])
        both = same & F.expr("a.y_end < b.y_start AND b.y_end < a.y_start")
        odd = lambda rows: rows.filter("y_start > y_end")
        for x, y in ((odd(one), two), (one.filter("y_start <= y_end"), odd(two))):
            total = total.union(x.alias("a").join(y.alias("b"), both).agg(F.sum(wide(F.col("a.m") * F.col("b.m"))).alias("n")))
    return total.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def changed_count(n: int, gone: DataFrame, new: DataFrame, rest: DataFrame, time: str = "year", location: str = "city") -> int:
    """``n``, the pairs of ``gone`` and ``rest`` together, once ``gone`` has given way to ``new`` (all sets of whole books)."""
    parts = [E.pair_count(new, time, location), between_count(new, rest, time, location), E.pair_count(gone, time, location), between_count(gone, rest, time, location)]
    marked = [p.select((F.col("n") * sign).alias("n")) for p, sign in zip(parts, (1, 1, -1, -1))]
    return n + reduce(DataFrame.union, marked).agg(F.sum("n").alias("n")).first()["n"]
