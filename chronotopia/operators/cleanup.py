"""Completeness of events, era estimates and chronology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import HIERARCHY, TRANSIT_FIELDS

YEARS = ("time_year_range_start", "time_year_range_end", "time_year")


def _any(*cols: str) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()


def has_usable_location() -> Column:
    """A level of the place is known, or, on a journey, an end."""
    return _any(*HIERARCHY) | ((F.col("location_type") == "transit") & _any(*TRANSIT_FIELDS))


def has_usable_date() -> Column:
    """A year or a bound of a range is known; month and day alone are no date."""
    return _any(*YEARS)


def dated_events(events: DataFrame) -> DataFrame:
    """Events with any part of a date, which are put in order."""
    return events.filter(_any(*YEARS, "time_month", "time_day"))


def filter_complete_events(events: DataFrame, estimates: DataFrame, strict: bool = False) -> DataFrame:
    """Events with a place and a date; those without a date get the book's estimated range if it is at least medium sure.

    ``strict`` also takes the order in the story from events that get an estimate.
    """
    own = estimates.filter(F.col("setting_confidence").isin("medium", "high")).select(
        "book_id", F.col("year_range_start").alias("_a"), F.col("year_range_end").alias("_z"), F.lit(True).alias("_known")
    )
    rows = events.filter(has_usable_location()).withColumn("_dated", has_usable_date()).join(own, "book_id", "left")
    rows = rows.filter(F.col("_dated") | F.col("_known"))
    new = {
        "time_year_range_start": F.col("_a"), "time_year_range_end": F.col("_z"), "time_year": F.lit(None).cast("int"), "time_month": F.lit(None).cast("int"),
        "time_day": F.lit(None).cast("int"), "time_precision": F.lit("year_range"), "time_source": F.lit("book_estimated"),
    }
    if strict:
        new |= {c: F.lit(None).cast(events.schema[c].dataType) for c in ("story_chronological_order", "ordering_confidence") if c in events.columns}
    out = [F.when(F.col("_dated"), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in events.columns]
    return rows.select(*out)


def merge_chronology(events: DataFrame, assignments: DataFrame) -> DataFrame:
    """Order in the story by event; of several assignments (position) the last counts, unknown ids are ignored."""
    last = F.max_by(F.struct("story_chronological_order", "ordering_confidence"), F.col("position")).alias("_o")
    found = assignments.groupBy("event_id").agg(last)
    rest = [c for c in events.columns if c not in ("story_chronological_order", "ordering_confidence")]
    return events.join(found, "event_id", "left").select(*rest, "_o.story_chronological_order", "_o.ordering_confidence")


def rule_chronology(events: DataFrame) -> DataFrame:
    """An offline substitute for the model's ordering (an extension): by earliest date, then kind of telling, then telling."""
    rank = F.when(F.col("temporal_relation") == "flashback", 0).when(F.col("temporal_relation") == "flash_forward", 2).otherwise(1)
    first = F.coalesce("time_year", "time_year_range_start", "time_year_range_end")
    w = Window.partitionBy("book_id").orderBy(first.asc_nulls_last(), F.col("time_month").asc_nulls_last(), F.col("time_day").asc_nulls_last(), rank, "chapter", "narration_order", "event_id")
    return dated_events(events).select("event_id", F.row_number().over(w).alias("story_chronological_order"))
