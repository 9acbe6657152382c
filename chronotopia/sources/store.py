"""Books as runs of Parquet tables with a manifest: a run is visible as a whole once its manifest row is written.

Each table of a run lies under <root>/<table>/run_id=<id>; the manifest, written last and by itself, names the runs that
count and the books of them that count no more, so readers never see half a run, and replacing or removing a book is a
manifest row too.

Working ids are unique inside a book at most (every book has a ``loc_1``). What is saved by ``process_and_save`` has ids
that last: digests of the run, the book and the working id, the same wherever they are computed, so no table of ids has to
be joined, and unique over books and runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import MAX_CHAPTERS
from ..operators.places import transit_shape_violations
from .session import remove_path

BOOK_TABLES = ("books", "characters", "locations", "events", "character_duplicate_flags")


def id_remap(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``column`` replaced through ids (book_id, old_id, new_id); an id that is not there is an error."""
    out = rows.join(ids.select("book_id", F.col("old_id").alias(column), "new_id"), ["book_id", column], "left")
    missing = F.raise_error(F.concat(F.lit(f"unknown {column} "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    new = F.coalesce("new_id", missing.cast(ids.schema["new_id"].dataType)).alias(column)
    return out.select(*[new if c == column else F.col(c) for c in rows.columns])


def id_remap_members(rows: DataFrame, ids: DataFrame, column: str, key: str) -> DataFrame:
    """As ``id_remap``, of ids inside the array ``column``, order kept; ``key`` names a row of a book. A member that is not there is an error."""
    each = rows.select("book_id", key, F.posexplode(column).alias("_at", "_member"))
    new = id_remap(each, ids, "_member").groupBy("book_id", key).agg(F.array_sort(F.collect_list(F.struct("_at", "_member"))).alias("_new"))
    out = F.when(F.col(column).isNotNull(), F.coalesce(F.transform("_new", lambda x: x["_member"]), F.array())).alias(column)
    return rows.join(new, ["book_id", key], "left").select(*[out if c == column else F.col(c) for c in rows.columns])


def lasting(run_id: str, *ids: Column | str) -> Column:
    """The lasting id of a working id: a digest of the run, the book and the id. Null stays null."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in ids]
    return F.when(cols[-1].isNotNull(), F.sha2(F.concat_ws("\0", F.lit(run_id), *cols), 256))


def surrogate_ids(rows: DataFrame, column: str, run_id: str) -> DataFrame:
    """(book_id, old_id, new_id): the lasting ids of a table's working ids."""
    return rows.select("book_id", F.col(column).alias("old_id"), lasting(run_id, "book_id", column).alias("new_id")).distinct()


#: Columns with ids, besides book_id, of each table; those in arrays are members.
IDS = {"characters": ("character_id",), "locations": ("location_id",), "events": ("event_id", "character_id", "location_id"), "character_duplicate_flags": ("flag_id", "canonical_id")}
MEMBERS = {"character_duplicate_flags": ("character_ids",)}


def lasting_ids(tables: dict[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    """All tables with lasting ids in place of working ids; a book's own becomes ``source_book_id``."""
    out = {}
    for name, rows in tables.items():
        for c in MEMBERS.get(name, ()):  # before book_id is another
            rows = rows.withColumn(c, F.transform(c, lambda x: lasting(run_id, F.col("book_id"), x)))
        new = {c: lasting(run_id, "book_id", c) for c in IDS.get(name, ())}
        cols = [new.get(c, lasting(run_id, c) if c == "book_id" else F.col(f"`{c}`")).alias(c) for c in rows.columns]
        out[name] = rows.select(*cols, *([F.col("book_id").cast("string").alias("source_book_id")] if name == "books" and "source_book_id" not in rows.columns else []))
    return out


def validate(tables: dict[str, DataFrame]) -> None:
    """Raise unless references are met (those of flags' members too) and journeys have their shape."""
    checks = {
        "events without character": tables["events"].join(tables["characters"], ["book_id", "character_id"], "left_anti"),
        "events without location": tables["events"].join(tables["locations"], ["book_id", "location_id"], "left_anti"),
        "characters without book": tables["characters"].join(tables["books"], "book_id", "left_anti"),
        "journeys out of shape": transit_shape_violations(tables["locations"]),
    }
    if "character_duplicate_flags" in tables:
        named = F.explode(F.array_union("character_ids", F.array("canonical_id"))).alias("character_id")
        checks["flags with an unknown member"] = tables["character_duplicate_flags"].select("book_id", named).join(tables["characters"], ["book_id", "character_id"], "left_anti")
    for what, rows in checks.items():
        if not rows.isEmpty():
            raise ValueError(what)


MANIFEST = "run_id string, book_id string, live boolean"


def _note(spark: SparkSession, root: str, rows: DataFrame) -> None:
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def save_books(tables: dict[str, DataFrame], root: str, run_id: str, replaces: str | None = None, replace_books: bool = False) -> None:
    """Write all tables of a run, check them as written, then add the manifest's row.

    ``replaces`` names a run that counts no more; with ``replace_books`` the older versions of these books (of one
    source_book_id) count no more, and what else their runs hold stays. A run that fails its checks is taken away again.
    """
    spark = tables["books"].sparkSession
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/run_id={run_id}")
    written = {name: spark.read.parquet(f"{root}/{name}/run_id={run_id}") for name in tables}
    try:
        validate(written)
    except ValueError:
        for name in tables:
            remove_path(spark, f"{root}/{name}/run_id={run_id}")
        raise
    rows = spark.createDataFrame([(run_id, None, True)] + ([(replaces, None, False)] if replaces else []), MANIFEST)
    if replace_books and _exists(spark, f"{root}/manifest"):
        again = written["books"].select("source_book_id").distinct()
        rows = rows.union(load(spark, root, "books").join(again, "source_book_id", "left_semi").select("run_id", "book_id", F.lit(False)))
    _note(spark, root, rows)


def remove_books(spark: SparkSession, root: str, source_book_id: str) -> None:
    """All versions of a book count no more."""
    gone = load(spark, root, "books").filter(F.col("source_book_id") == source_book_id)
    _note(spark, root, gone.select(F.col("run_id").cast("string").alias("run_id"), "book_id", F.lit(False).alias("live")))


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder of any store holds; nothing if it is not there."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(own)] if fs.exists(own) else []


def load_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all runs, whether they count or not."""
    rows = spark.read.option("basePath", f"{root}/{name}").option("mergeSchema", "true").parquet(f"{root}/{name}")
    return rows.withColumn("run_id", F.col("run_id").cast("string"))


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all runs and books that count."""
    w = Window.partitionBy("run_id", "book_id").orderBy(F.desc("at"), "live")
    last = spark.read.schema(f"{MANIFEST}, at timestamp").parquet(f"{root}/manifest").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    rows = load_all(spark, root, name).join(last.filter("book_id IS NULL AND live").select("run_id"), "run_id", "left_semi")
    gone = last.filter("book_id IS NOT NULL AND NOT live").select("run_id", "book_id")
    return rows.withColumn("_book", F.col("book_id").cast("string")).join(gone.withColumnRenamed("book_id", "_book"), ["run_id", "_book"], "left_anti").drop("_book")


def already_processed(worklist: DataFrame, books: DataFrame, key: str = "gutenberg_id") -> DataFrame:
    """What of a worklist no book stands for yet."""
    return worklist.join(books.select(key).distinct(), key, "left_anti")


def book_counts(books: DataFrame, characters: DataFrame, locations: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of each book in the three tables."""
    out = books.select("book_id")
    for name, rows in (("characters", characters), ("locations", locations), ("events", events)):
        out = out.join(rows.groupBy("book_id").agg(F.count("*").alias(name)), "book_id", "left")
    return out.na.fill(0, ["characters", "locations", "events"])


def reprocess_candidates(books: DataFrame, most: int = MAX_CHAPTERS) -> DataFrame:
    """action of each book (chapters, chapters_processed): kept if too long, done if all was read, else reprocess."""
    action = F.when(F.col("chapters") > most, "kept").when(F.col("chapters_processed") >= F.col("chapters"), "done").otherwise("reprocess")
    return books.withColumn("action", action)
