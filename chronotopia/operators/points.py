"""Normalising views: what places an event can be matched on, and how it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import readable_location, readable_time
from ..functions.vocabulary import LOCATION_LEVELS


def place_key(locations: DataFrame) -> list[str]:
    """What names a place: its id inside its book, or the id alone where the table has no books."""
    return [c for c in ("book_id", "location_id") if c in locations.columns]


def location_points(locations: DataFrame) -> DataFrame:
    """The place's key, point_role, country, region, city, neighborhood: a place, or a journey's ends that are known.

    One scan; a journey's ends have no region and no neighbourhood.
    """
    none = F.lit(None).cast("string")
    point = lambda role, *levels: F.struct(F.lit(role).alias("point_role"), *[x.alias(n) for n, x in zip(LOCATION_LEVELS, levels)])
    col = F.col
    journey = [point(side, col(f"transit_{side}_country"), none, col(f"transit_{side}_city"), none) for side in ("from", "to")]
    journey = F.filter(F.array(*journey), lambda p: p["country"].isNotNull() | p["city"].isNotNull())
    place = F.array(point("place", *[col(n) for n in LOCATION_LEVELS]))
    found = F.explode(F.when(col("location_type") == "transit", journey).when(col("location_type").isNotNull(), place)).alias("p")
    key = place_key(locations)
    return locations.select(*key, found).select(*key, "p.*")


def event_match_points(events: DataFrame, locations: DataFrame) -> DataFrame:
    """One row for each dated event and point; a stated range goes before the year, places are folded to compare."""
    dated = events.filter(F.col("time_precision").isNotNull())
    joined = dated.join(location_points(locations), place_key(locations))
    return joined.select(
        "event_id", "book_id", "character_id",
        F.coalesce("time_year_range_start", "time_year").alias("y_start"), F.coalesce("time_year_range_end", "time_year").alias("y_end"),
        "time_month", "time_day", "location_id", "point_role", *[F.lower(F.trim(n)).alias(n) for n in LOCATION_LEVELS],
    )


def event_readable(events: DataFrame, books: DataFrame, characters: DataFrame, locations: DataFrame) -> DataFrame:
    """How an event reads: book, character, place, time and evidence, with the place's own columns."""
    places = locations.select(
        *place_key(locations), readable_location().alias("readable_location"), "location_type", "country", "region", "city", "transit_to_country", "transit_to_city"
    )
    return (
        events.withColumn("readable_time", readable_time())
        .join(books.select("book_id", F.col("title").alias("book_title")), "book_id")
        .join(characters.select("book_id", "character_id", F.col("canonical_name").alias("character_name")), ["book_id", "character_id"])
        .join(places, place_key(locations))
        .select(
            "event_id", "book_id", "book_title", "character_name", "readable_location", "readable_time", "evidence_quote", "location_type",
            "country", "region", "city", "transit_to_country", "transit_to_city",
        )
    )
