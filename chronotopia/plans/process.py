"""Novels to the five saved tables: every operator of the book pipeline in its order, the models and services injected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleanup, fold, people, places, text
from ..sources import store
from ..sources.session import checkpointed, let_go

Answer = Callable[[DataFrame], DataFrame]


def by_rule(dated: DataFrame) -> DataFrame:
    """Orders by rule, where no model puts events in order."""
    return cleanup.rule_chronology(dated).select("event_id", "story_chronological_order", F.lit("certain").alias("ordering_confidence"), F.lit(0).alias("position"))


@dataclass(frozen=True)
class Services:
    """Who answers what. Each gets a DataFrame and returns one.

    declare: chapters -> (book_id, chapter, new_characters: JSON text); events: chapters -> (book_id, chapter, ordinal,
    character_id, places.TIME, time_precision, time_source, places.PLACE, temporal_relation, confidence, evidence_quote);
    estimate: (book_id, opening) -> (book_id, year_range_start, year_range_end, setting_confidence); duplicates: characters
    with evidence -> (book_id, position, canonical_id, character_ids, confidence); order: dated events -> assignments.
    gazetteer: rows of look-ups, as places.geo_backfill takes them, or locations -> such rows (``lookups.gazetteer``).
    """

    declare: Answer
    events: Answer
    estimate: Answer
    duplicates: Answer
    gazetteer: DataFrame | Answer
    order: Answer = by_rule


def chapters_of(novels: DataFrame, percent: float = 100) -> DataFrame:
    """(book_id, chapter, title, paragraphs, text) of novels (book_id, text), the first ``percent`` of each book's chapters."""
    clean = novels.select("book_id", text.strip_boilerplate(F.col("text")).alias("text"))
    return text.chapter_sample(text.split_chapters(clean), percent).withColumn("text", text.chapter_text(F.col("paragraphs")))


def process_books(novels: DataFrame, services: Services, targets: DataFrame | None = None, percent: float = 100) -> dict[str, DataFrame]:
    """The five tables of novels (book_id, title, text), with working ids. ``targets`` (book_id, name, ordinal) limits whose events count.

    Chapters, what a service answers and the refined events are kept by checkpoints: a service is asked once, however often
    the tables are read. Flags keep the groups that are not certain, as given; ``store.validate`` refuses one whose member a certain group took.
    """
    chapters = checkpointed(chapters_of(novels, percent))
    declared = fold.normalize_new_characters(checkpointed(services.declare(chapters))).withColumn("kind", F.lit(0))
    events = checkpointed(services.events(chapters))
    if targets is not None:
        seeds = fold.seed_characters(targets)
        declared, events = declared.unionByName(seeds), fold.filter_targets(events, seeds)
    registry = fold.merge_registry(declared.unionByName(fold.orphan_placeholders(declared, events)))
    characters = registry.select("book_id", F.col("id").alias("character_id"), "canonical_name", "aliases")
    events = fold.stamp_events(events)
    events = cleanup.merge_chronology(events.drop("story_chronological_order"), checkpointed(services.order(cleanup.dated_events(events))))
    estimates = checkpointed(services.estimate(text.setting_sample(chapters)))
    certain, other = people.split_groups(checkpointed(services.duplicates(people.dedup_context(characters, events))))
    members = certain.select("book_id", "position", "canonical_id", F.explode("character_ids").alias("member_id"))
    characters, events = people.apply_merges(characters, events, people.redirect_map(members))
    events = cleanup.filter_complete_events(events, estimates)
    # The order of telling: chapters first, then places in them.
    events = events.withColumn("ordinal", F.shiftleft(F.col("chapter").cast("long"), 32) + F.col("narration_order"))
    events, locations = places.finalize_locations(checkpointed(places.refine_locations(events)))
    known = services.gazetteer if isinstance(services.gazetteer, DataFrame) else checkpointed(services.gazetteer(locations))
    books = novels.drop("text").join(estimates, "book_id", "left").join(chapters.groupBy("book_id").agg(F.count("*").alias("chapters_processed")), "book_id", "left")
    flags = other.withColumn("flag_id", F.sha2(F.concat_ws("\0", "book_id", F.col("position").cast("string")), 256)).withColumn("status", F.lit("pending")).withColumn("created_at", F.current_timestamp())
    return {
        "books": books, "characters": characters, "locations": places.geo_backfill(locations, known), "events": events.drop("ordinal"),
        "character_duplicate_flags": flags,
    }


def process_and_save(novels: DataFrame, services: Services, root: str, run_id: str, replaces: str | None = None, targets: DataFrame | None = None, percent: float = 100, replace_books: bool = False) -> None:
    """``process_books``, then all tables of the run, with ids that last, or none; see ``store.save_books``."""
    tables = store.lasting_ids(process_books(novels, services, targets, percent), run_id)
    let_go(novels.sparkSession)
    store.save_books(tables, root, run_id, replaces, replace_books)
    del tables
    let_go(novels.sparkSession)
