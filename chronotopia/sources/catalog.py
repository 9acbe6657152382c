"""The book catalogue, and answers of language models, as injected tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import PLAIN_TEXT


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text): every file as one row, read by the executors; a path that is not there is an error."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def search(catalog: DataFrame, title: str, author: str) -> DataFrame:
    """Books of which title or authors hold every word of the request."""
    hay = F.lower(F.concat_ws(" ", "title", F.array_join(F.transform("authors", lambda a: a["name"]), " ")))
    words = f"{title} {author}".lower().split()
    cond = F.lit(True)
    for w in words:
        cond = cond & F.contains(hay, F.lit(w))
    return catalog.filter(cond)


def get(catalog: DataFrame, book: int) -> DataFrame:
    return catalog.filter(F.col("id") == book)


def pick_format_url(formats: Column) -> Column:
    """Address of the best plain-text format of a map from format to address; null if there is none."""
    other = F.get(F.filter(F.map_entries(formats), lambda e: F.startswith(e["key"], F.lit("text/plain"))), F.lit(0))["value"]
    return F.coalesce(*[F.try_element_at(formats, F.lit(m)) for m in PLAIN_TEXT], other)


def novel_metadata(books: DataFrame) -> DataFrame:
    """Title, author (all names, else the one asked for), language (English if it is one) and the first author's years."""
    names = F.array_join(F.transform("authors", lambda a: a["name"]), ", ")
    first = F.get("authors", F.lit(0))
    return books.select(
        "id", "title", F.when(names == "", F.col("asked_author")).otherwise(names).alias("author"),
        F.when(F.array_contains("languages", "en"), "en").otherwise(F.get("languages", F.lit(0))).alias("language"),
        "download_count", first["birth_year"].alias("author_birth_year"), first["death_year"].alias("author_death_year"),
    )


def pick_best_edition(found: DataFrame) -> DataFrame:
    """Of each request's hits (request, position, languages, download_count): English before others, then most downloads, then first."""
    english = F.coalesce(F.array_contains("languages", "en"), F.lit(False))
    w = Window.partitionBy("request").orderBy(english.desc(), F.coalesce("download_count", F.lit(0)).desc(), "position")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def json_extract(text: Column) -> Column:
    """The JSON of a model's answer as text: the whole (without a code fence), else from the first brace to the last; null if neither parses."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    last = F.length(bare) - F.locate("}", F.reverse(bare)) + 1
    span = F.substring(bare, F.locate("{", bare), F.greatest(last - F.locate("{", bare) + 1, F.lit(0)))
    parses = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(parses(bare), bare).when((F.locate("{", bare) > 0) & parses(span), span)
