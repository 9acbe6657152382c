"""Per-chapter extraction answers folded to registries and stamped events, as set operations.

A declaration's place in the story is (chapter, kind, ordinal), kind 0 for declared, 1 for a placeholder that the same
chapter needed; the first declaration of (book, id) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slugify(name: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("character"))


def seed_characters(targets: DataFrame) -> DataFrame:
    """Declarations (chapter 0) of a target list (book_id, name, ordinal); names that give one id stay separate rows here."""
    return targets.select(
        "book_id", F.lit(0).alias("chapter"), F.lit(0).alias("kind"), "ordinal", slugify(F.col("name")).alias("id"), F.col("name").alias("canonical_name"),
        F.array().cast("array<string>").alias("aliases"),
    )


def filter_targets(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events of the target ids (book_id, id) only; an empty list drops all."""
    keep = targets.select("book_id", F.col("id").alias("character_id")).distinct()
    return events.join(keep, ["book_id", "character_id"], "left_semi")


def normalize_new_characters(answers: DataFrame) -> DataFrame:
    """(book_id, chapter, ordinal, id, canonical_name, aliases) from the JSON text ``new_characters``.

    What is no array counts as empty; a bare string in it as an id that is its own name.
    """
    v = F.try_parse_json("new_characters")
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = answers.select("book_id", "chapter", F.posexplode(items).alias("ordinal", "item"))
    bare = F.schema_of_variant("item") == "STRING"
    of = lambda path, kind: F.try_variant_get("item", path, kind)
    whole = F.when(bare, of("$", "string"))
    return rows.select(
        "book_id", "chapter", "ordinal", F.coalesce(whole, of("$.id", "string")).alias("id"), F.coalesce(whole, of("$.canonical_name", "string")).alias("canonical_name"),
        F.coalesce(F.when(~bare, of("$.aliases", "array<string>")), F.array().cast("array<string>")).alias("aliases"),
    ).filter("id IS NOT NULL")


def orphan_placeholders(declared: DataFrame, events: DataFrame) -> DataFrame:
    """Declarations (kind 1) of ids that events use in a chapter before or without any declaration, in their first such chapter."""
    first = declared.groupBy("book_id", F.col("id").alias("character_id")).agg(F.min("chapter").alias("since"))
    used = events.groupBy("book_id", "character_id").agg(F.min(F.struct("chapter", "ordinal")).alias("u"))
    orphan = used.join(first, ["book_id", "character_id"], "left").filter("since IS NULL OR since > u.chapter")
    return orphan.select(
        "book_id", F.col("u.chapter").alias("chapter"), F.lit(1).alias("kind"), F.col("u.ordinal").alias("ordinal"), F.col("character_id").alias("id"),
        F.concat(F.lit("Unknown ("), F.col("character_id"), F.lit(")")).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"),
    )


def merge_registry(declared: DataFrame) -> DataFrame:
    """The first declaration of each (book_id, id), whole; later ones are ignored."""
    rest = [c for c in declared.columns if c not in ("book_id", "id", "chapter", "kind", "ordinal")]
    one = F.min_by(F.struct("chapter", "kind", "ordinal", *rest), F.struct("chapter", "kind", "ordinal")).alias("x")
    return declared.groupBy("book_id", "id").agg(one).select("book_id", "id", "x.*")


def stamp_events(events: DataFrame) -> DataFrame:
    """narration_order from 1 in each chapter, no chronology yet, and the event's id."""
    w = Window.partitionBy("book_id", "chapter").orderBy("ordinal")
    rows = events.withColumn("narration_order", F.row_number().over(w)).withColumn("story_chronological_order", F.lit(None).cast("int"))
    return rows.withColumn("event_id", F.concat_ws("_", F.coalesce(F.nullif(F.col("book_id").cast("string"), F.lit("")), F.lit("book")), "chapter", "character_id", "narration_order"))


def prompt_state(characters: DataFrame, locations: DataFrame) -> DataFrame:
    """(book_id, state): the registries as JSON for a prompt; locations by name only."""
    def pack(df, *cols):
        return df.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("id", *cols))).alias("x"))

    both = pack(characters, "canonical_name", "aliases").withColumnRenamed("x", "characters").join(pack(locations, "canonical_name").withColumnRenamed("x", "locations"), "book_id", "full")
    return both.select("book_id", F.to_json(F.struct("characters", "locations")).alias("state"))


def flatten_events(events: DataFrame) -> DataFrame:
    """Nested events (time, sequence) as the flat table's columns."""
    time = {"time_year_range_start": "year_range_start", "time_year_range_end": "year_range_end", "time_year": "year", "time_month": "month", "time_day": "day"}
    return events.select(
        "event_id", "book_id", "character_id", "location_id", "chapter", *[F.col(f"time.hierarchy.{c}").alias(n) for n, c in time.items()],
        F.col("time.precision").alias("time_precision"), F.col("time.source").alias("time_source"), F.col("sequence.narration_order").alias("narration_order"),
        F.col("sequence.story_chronological_order").alias("story_chronological_order"), "ordering_confidence", "temporal_relation", "evidence_quote", "confidence",
    )
