"""Characters that are one person: redirects, merges and review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import EVIDENCE_HALF
from ..sources.session import checkpointed


def evidence_sample(events: DataFrame, half: int = EVIDENCE_HALF) -> DataFrame:
    """Of each character the first and last ``half`` events in order; all, if there are no more."""
    w = Window.partitionBy("book_id", "character_id")
    rows = events.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("chapter", "narration_order", "event_id")))
    return rows.filter((F.col("_n") <= 2 * half) | (F.col("_k") <= half) | (F.col("_k") > F.col("_n") - half)).drop("_n", "_k")


def dedup_context(characters: DataFrame, events: DataFrame) -> DataFrame:
    """Each character with its sampled evidence, in order; an empty list if there is none."""
    own = evidence_sample(events).groupBy("book_id", "character_id").agg(
        F.array_sort(F.collect_list(F.struct("chapter", "narration_order", "event_id", "evidence_quote"))).alias("e")
    )
    quotes = F.transform("e", lambda x: F.struct(x["chapter"].alias("chapter"), x["evidence_quote"].alias("evidence_quote")))
    none = F.array().cast("array<struct<chapter:int,evidence_quote:string>>")
    return characters.join(own, ["book_id", "character_id"], "left").withColumn("evidence", F.coalesce(quotes, none)).drop("e")


def split_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups that are certain, and all others."""
    sure = F.coalesce(F.col("confidence") == "certain", F.lit(False))
    return groups.filter(sure), groups.filter(~sure)


def redirect_map(members: DataFrame) -> DataFrame:
    """(book_id, old_id, new_id) from members of certain groups (book_id, position, canonical_id, member_id).

    A later group replaces an earlier one's redirect of the same id; chains are followed to their end by doubling
    steps. A cycle is an error, as it would leave nobody.
    """
    last = F.max_by("canonical_id", "position").alias("new_id")
    direct = members.filter("member_id <> canonical_id").groupBy("book_id", F.col("member_id").alias("old_id")).agg(last)
    hops = checkpointed(direct)
    for _ in range(hops.count().bit_length() + 1):  # steps double, so no chain is longer than that
        b = hops.select("book_id", F.col("old_id").alias("new_id"), F.col("new_id").alias("_next"))
        step = checkpointed(hops.join(b, ["book_id", "new_id"], "left"))
        if step.filter("_next IS NOT NULL").isEmpty():
            return hops
        hops = step.select("book_id", "old_id", F.coalesce("_next", "new_id").alias("new_id"))
    raise ValueError("duplicate groups redirect in a cycle")


def apply_merges(characters: DataFrame, events: DataFrame, redirect: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(characters, events): merged ones go, survivors get their names, events point to survivors.

    The survivor's own name stays out only if nobody else bore it.
    """
    gone = redirect.select("book_id", F.col("old_id").alias("character_id"), "new_id")
    names = characters.join(gone, ["book_id", "character_id"]).select("book_id", "new_id", F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("n"))
    more = names.groupBy("book_id", F.col("new_id").alias("character_id")).agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("_more"))
    kept = characters.join(gone.drop("new_id"), ["book_id", "character_id"], "left_anti").join(more, ["book_id", "character_id"], "left")
    aliases = F.when(F.col("_more").isNotNull(), F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.col("_more")))).otherwise(F.col("aliases"))
    moved = events.join(gone, ["book_id", "character_id"], "left").withColumn("character_id", F.coalesce("new_id", "character_id")).select(*events.columns)
    return kept.withColumn("aliases", aliases).select(*characters.columns), moved


def flags_pending(flags: DataFrame, books: DataFrame, characters: DataFrame) -> DataFrame:
    """Flags that wait for review, oldest first where the table has created_at, with the book's title and the members' names (``?`` where one is missing)."""
    own = flags.filter("status = 'pending'").join(books.select("book_id", "title"), "book_id")
    when = [c for c in ("created_at",) if c in flags.columns]
    key = ["flag_id", "book_id", "title", "confidence", "canonical_id", *when]
    rows = own.select(*key, F.posexplode("character_ids").alias("at", "character_id"))
    rows = rows.join(characters.select("book_id", "character_id", "canonical_name"), ["book_id", "character_id"], "left")
    names = F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical_name", F.lit("?")).alias("n"))))
    found = rows.groupBy(*key).agg(F.array_join(F.transform(names, lambda x: x["n"]), ", ").alias("members"))
    return found.orderBy(*when, "flag_id") if when else found


def flag_approve(flag_id, flags: DataFrame, characters: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flags, characters, events) after merging a pending flag's members; the survivor's own name is no alias of it."""
    ok = (F.col("flag_id") == flag_id) & (F.col("status") == "pending")
    members = flags.filter(ok).select("book_id", "canonical_id", F.explode("character_ids").alias("character_id"))
    names = characters.join(members, ["book_id", "character_id"]).select("book_id", "canonical_id", F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("n"))
    more = names.groupBy("book_id", F.col("canonical_id").alias("character_id")).agg(F.flatten(F.collect_list("n")).alias("_n"))
    gone = members.filter("character_id <> canonical_id").withColumnRenamed("canonical_id", "_to")
    kept = characters.join(gone, ["book_id", "character_id"], "left_anti").join(more, ["book_id", "character_id"], "left")
    aliases = F.when(F.col("_n").isNotNull(), F.array_sort(F.array_except("_n", F.array("canonical_name")))).otherwise(F.col("aliases"))
    moved = events.join(gone, ["book_id", "character_id"], "left").withColumn("character_id", F.coalesce("_to", "character_id")).select(*events.columns)
    return flags.withColumn("status", F.when(ok, "approved").otherwise(F.col("status"))), kept.withColumn("aliases", aliases).select(*characters.columns), moved


def flag_reject(flag_id, flags: DataFrame) -> DataFrame:
    """A pending flag is rejected; any other stays."""
    ok = (F.col("flag_id") == flag_id) & (F.col("status") == "pending")
    return flags.withColumn("status", F.when(ok, "rejected").otherwise(F.col("status")))
