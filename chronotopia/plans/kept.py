"""Pair counts and countries of the saved books, kept in a table and brought up to date from the manifest.

Each state is a folder of its own and counts once its list of books is written, which is the last thing; a reader takes
the last whole state. Lasting book ids are never used again, so books that are counted but not live any more have gone, and
live ones that are not counted are new; a replaced book is both.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import CONTINENTS, LOCATION_GRANULARITIES, TIME_GRANULARITIES
from ..operators import encounters as E
from ..operators import points as P
from ..operators.deltas import changed_count
from ..sources import store
from ..sources.adapters import duck, view
from .encounter_queries import MATCH_POINTS, location_sql, time_sql

QUERIES, ORACLES = {}, {}
ALL = tuple((t, p) for t in TIME_GRANULARITIES for p in LOCATION_GRANULARITIES)


def _points_of(spark: SparkSession, root: str, books: DataFrame) -> DataFrame:
    """Match points of these books, live or not."""
    own = lambda name: store.load_all(spark, root, name).join(F.broadcast(books), "book_id", "left_semi")
    return P.event_match_points(own("events"), own("locations"))


def _states(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("state=")) for n in store.names(spark, path) if n.startswith("state=") and store._exists(spark, f"{path}/{n}/books/_SUCCESS"))


def refresh(spark: SparkSession, root: str, path: str, granularities: Iterable[tuple[str, str]] = ALL) -> None:
    """Bring the kept counts at ``path`` up to date with the store at ``root``; granularities not kept so far are counted whole."""
    states, live = _states(spark, path), store.load(spark, root, "books").select("book_id").distinct()
    last = f"{path}/state={states[-1]}" if states else None
    counted = spark.read.parquet(f"{last}/books") if last else live.limit(0)
    kept = {(r.time, r.location): r.n for r in spark.read.parquet(f"{last}/counts").collect()} if last else {}
    gone, new = counted.join(live, "book_id", "left_anti"), live.join(counted, "book_id", "left_anti")
    if last and gone.isEmpty() and new.isEmpty() and set(granularities) <= set(kept):
        return
    stay = live.join(counted, "book_id", "left_semi")
    p_gone, p_new, p_stay = (_points_of(spark, root, x) for x in (gone, new, stay))
    every = _points_of(spark, root, live)
    rows = []
    for time, location in dict.fromkeys([*kept, *granularities]):
        if (time, location) in kept:
            rows.append((time, location, changed_count(kept[time, location], p_gone, p_new, p_stay, time, location)))
        else:
            rows.append((time, location, E.pair_count(every, time, location).first()["n"]))
    at = f"{path}/state={states[-1] + 1 if states else 0}"
    spark.createDataFrame(rows, "time string, location string, n long").coalesce(1).write.mode("overwrite").parquet(f"{at}/counts")
    named = lambda p: p.filter(F.col("country").isNotNull() & ~F.col("country").isin(*CONTINENTS)).select("country", "book_id").distinct()
    before = spark.read.parquet(f"{last}/countries").join(gone, "book_id", "left_anti").select("country", "book_id") if last else None
    (before.union(named(p_new)) if last else named(every)).write.mode("overwrite").parquet(f"{at}/countries")
    live.write.mode("overwrite").parquet(f"{at}/books")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(time, location, n) as last brought up to date."""
    return spark.read.parquet(f"{path}/state={_states(spark, path)[-1]}/counts")


def countries(spark: SparkSession, path: str) -> DataFrame:
    """Countries that at least two books name, as last brought up to date."""
    named = spark.read.parquet(f"{path}/state={_states(spark, path)[-1]}/countries")
    return named.groupBy("country").agg(F.count("*").alias("n")).filter("n >= 2").select("country").orderBy("country")


# One book gives way to another version of it, of which only some events stay; another one comes.
CHANGED = (("year", "city"), ("day", "country"), ("none", "neighborhood"))
_NEW = "book_id = 'BUILDING' AND event_id % 2 = 0 OR book_id = 'MACHINERY'"


def _after_change(spark: SparkSession, d: str) -> DataFrame:
    p = P.event_match_points(view(spark, d, "presence"), view(spark, d, "locations"))
    gone, new, rest = p.filter("book_id = 'BUILDING'"), p.filter(_NEW), p.filter("book_id NOT IN ('BUILDING', 'MACHINERY')")
    rows = []
    for time, location in CHANGED:
        before = E.pair_count(p.filter("book_id <> 'MACHINERY'"), time, location).first()["n"]
        rows.append((time, location, changed_count(before, gone, new, rest, time, location)))
    return spark.createDataFrame(rows, "time string, location string, n long")


QUERIES["counts_after_change"] = _after_change
ORACLES["counts_after_change"] = duck("locations presence", "").rstrip() + f", pts AS (SELECT * FROM ({MATCH_POINTS}) WHERE book_id <> 'BUILDING' OR event_id % 2 = 0)\n" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS time, '{p}' AS location, count(*) AS n FROM pts a JOIN pts b ON a.book_id < b.book_id AND {time_sql(t)} AND {location_sql(p)}" for t, p in CHANGED
)
