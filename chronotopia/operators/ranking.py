"""Works, their characters' ranking, and usage totals."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What cached input costs against plain input.
CACHE_WRITE, CACHE_READ = 1.25, 0.1


def match_work(hits: DataFrame) -> DataFrame:
    """The first acceptable hit of each request (request, position, description, author): a novel or literary work by that author."""
    text = F.lower(F.coalesce("description", F.lit("")))
    kind = F.contains(text, F.lit("novel")) | F.contains(text, F.lit("literary work"))
    words = F.filter(F.split(F.lower(F.replace(F.coalesce("author", F.lit("")), F.lit(","), F.lit(" "))), r"\s+"), lambda w: F.length(w) > 2)
    ok = kind & ((F.size(words) == 0) | F.exists(words, lambda w: F.contains(text, w)))
    w = Window.partitionBy("request").orderBy("position")
    return hits.filter(ok).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rank_characters(characters: DataFrame, top_n: int | None = None) -> DataFrame:
    """Characters of each work (label, sitelinks, pageviews, position) by fame; those without a label are left out."""
    w = Window.partitionBy("work").orderBy(F.col("sitelinks").desc(), F.col("pageviews").desc(), "position")
    rows = characters.filter("label IS NOT NULL").withColumn("rank", F.row_number().over(w))
    return rows.filter(F.col("rank") <= top_n) if top_n else rows


def rich_works(works: DataFrame, characters: DataFrame, least: int = 3, limit: int | None = 100) -> DataFrame:
    """Works (work, title, author or null) with at least so many characters, the richest first."""
    counts = characters.groupBy("work").agg(F.count("*").alias("characters")).filter(F.col("characters") >= least)
    rows = works.join(counts, "work")
    return rows if limit is None else rows.orderBy(F.desc("characters"), "work").limit(limit)


def pageviews_sum(views: DataFrame, pages: DataFrame, today: datetime.date) -> DataFrame:
    """Views of each page in the 365 days that end two days before ``today``; none counts as 0."""
    end = today - datetime.timedelta(days=2)
    own = views.filter(F.col("day").between(F.lit(end - datetime.timedelta(days=365)), F.lit(end))).groupBy("page").agg(F.sum("views").alias("views"))
    return pages.join(own, "page", "left").withColumn("views", F.coalesce("views", F.lit(0)))


def usage_summary(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each model; calls of the command line cost nothing, unknown models have rate 0.

    ``prices``: model, input_rate, output_rate for a million tokens.
    """
    paid = lambda c: F.sum(F.when(F.col("cli"), 0).otherwise(F.col(c)))
    cols = ("input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens")
    sums = calls.groupBy("model").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in cols], *[paid(c).alias("_" + c) for c in cols]).join(prices, "model", "left")
    i, o = F.coalesce("input_rate", F.lit(0.0)), F.coalesce("output_rate", F.lit(0.0))
    cost = (F.col("_input_tokens") * i + F.col("_cache_write_tokens") * i * CACHE_WRITE + F.col("_cache_read_tokens") * i * CACHE_READ + F.col("_output_tokens") * o) / 1_000_000
    return sums.select("model", "calls", *cols, cost.alias("cost"))


def usage_total(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """One row over all models: calls, cost, and in ``equivalent_cost`` what the command line's calls would have cost."""
    line = usage_summary(calls.filter("cli").withColumn("cli", F.lit(False)), prices).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("equivalent_cost"))
    own = usage_summary(calls, prices).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return own.join(F.broadcast(line))  # one row each


def run_totals(entries: DataFrame) -> DataFrame:
    """One row over the entries that ran: how many, their time and tokens."""
    return entries.filter("elapsed IS NOT NULL").agg(F.count("*").alias("runs"), F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("elapsed"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
