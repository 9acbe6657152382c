"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's copy has as virtual finish time the words its source has
sent up to and including it, divided by the source's target (in whole words). The queue of all sources in that order is
cut where the total budget is spent. As the targets share out the budget, its last word is sent at time 1 (each source has
then sent its target), so the cut needs no search: a copy that finishes by then is in the mix, and of the one copy of each
source that is being sent at that time the first words are. A source's pass repeats up to three times, so no document is
taken more often. ``queue`` gives the copies range-sorted by virtual time; ``mix`` gives the texts, in no order.

Equal rows are counted first and written out again in blocks that are dealt to all tasks, and words sent so far are summed by (source, hash bin): a source or a group of copies that
holds most rows is spread over all tasks. Texts are not shuffled: which copies a row gives follows from its hash and one
row for each source.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, last in the order; rows with
null or shared doc_id are told apart by all their columns, and equal rows are interchangeable; an empty table gives no
rows; a source of size 0 has target 0. The table of sources (one row each) must fit the driver.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, checkpointed, own_names, row_key, running_sum, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: Hash bins of a source: bits.
BITS = 16
#: Equal rows that one task writes out at a time: bits.
BLOCK = 12


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, budget: float | None = None) -> list[float]:
    """Target of each source, in the order given; what targets above their source's ``repeats`` sizes leave is shared anew."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left = float(sum(n for _, n in sizes)) if budget is None else float(budget)
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > repeats * sizes[i][1]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i][1])
            open_.discard(i)
        left -= sum(out[i] for i in over)
    return out


def whole(goals: list[float], sizes: list[tuple[str | None, int]], repeats: int = REPEATS) -> list[int]:
    """``goals`` in whole words, of which as many are rounded up as keep the sum (largest part first)."""
    out = [floor(g) for g in goals]
    short = round(sum(goals)) - sum(out)
    for i in sorted(range(len(goals)), key=lambda i: (out[i] - goals[i], i))[:short]:
        out[i] = min(out[i] + 1, repeats * sizes[i][1])
    return out


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _order(at: str = "") -> list[Column]:
    """The shuffled order of a source's rows: that of the hash as an unsigned number, then of the whole key."""
    return [F.shiftrightunsigned(F.col(at + KEY[0]), 1), *(F.col(at + k) for k in KEY)]


def _part(e: Column) -> Column:
    """Words of the copy of pass ``e`` that are sent before the source's goal is reached."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - (e * F.col("source_size") + F.col("sent") - F.col("size")))).cast("long")


def _each(rows: DataFrame, count: Column, out: str) -> DataFrame:
    """``rows`` with the numbers from 1 to ``count`` as ``out``; those of one row are dealt to tasks in blocks."""
    # A number of partitions is named, as their size before the numbers are written out says nothing of it after.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(count - 1, BLOCK)))).repartition(parts, *KEY, "_block")
    first = F.shiftleft(F.col("_block"), BLOCK)
    return rows.withColumn(out, F.explode(F.sequence((first + 1).cast("int"), F.least(count, first + (1 << BLOCK)).cast("int")))).drop("_block")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, budget: float | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, goal, sent, finish, taken, nth) of every row, with its key.

    goal is the target in whole words, sent the source's words up to and including the row's, finish the virtual time
    then, taken the number of the row's words in the mix; nth numbers equal rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), *row_key(docs))
    rows = checkpointed(rows.groupBy("doc_id", "source", "size", *KEY).agg(F.count("*").alias("equal")))
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("n")).collect()]
    sizes.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goals = targets(sizes, weights, repeats, budget)
    shares = [(i, s, n, t, w) for i, ((s, n), t, w) in enumerate(zip(sizes, goals, whole(goals, sizes, repeats)))]
    shares = spark.createDataFrame(shares, "sid int, source string, source_size long, target double, goal long")
    rows = rows.alias("l").join(F.broadcast(shares).alias("r"), F.expr("l.source <=> r.source")).select("l.*", "r.sid", "r.source_size", "r.target", "r.goal")
    rows = rows.withColumn("bin", F.shiftrightunsigned(KEY[0], 64 - BITS).cast("int"))
    rows = running_sum(rows, ["sid"], "bin", _order(), F.col("size") * F.col("equal"), "sent", BITS // 2)
    # Equal rows follow one another.
    rows = _each(rows, F.col("equal"), "nth").withColumn("sent", F.col("sent") - (F.col("equal") - F.col("nth")) * F.col("size"))
    taken = sum((_part(F.lit(e)) for e in range(repeats)), F.lit(0)).cast("long")
    finish = F.when(F.col("target") > 0, F.col("sent") / F.col("target"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "goal", "sent", finish.alias("finish"), taken.alias("taken"), "nth", *KEY)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"([{SPACE}]*{WORD})"), F.lit(1)), F.lit(1), n.cast("int")), "")


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, budget: float | None = None) -> DataFrame:
    """(doc_id, source, pass, time, words) of every copy in the mix, range-sorted by its virtual finish time."""
    found = plan(docs, weights, repeats, budget).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    found = found.withColumn("words", _part(F.col("pass"))).filter("words > 0")
    time = (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("target")
    return found.select("doc_id", "source", "pass", time.alias("time"), "words").orderBy("time", "source", "pass")


def _copies(docs: DataFrame, weights: tuple[int, ...], repeats: int, budget: float | None) -> DataFrame:
    """``docs`` with _words (null: all) for every copy in the mix."""
    found = plan(docs, weights, repeats, budget).filter("source_size > 0")
    size, first = F.col("size"), F.col("goal") % F.col("source_size")
    # One row for each source: its whole passes, and the row in which its last pass ends.
    at = (size > 0) & (F.col("sent") - size < first) & (first <= F.col("sent"))
    end = F.struct(*KEY, (first - F.col("sent") + size).alias("rest"), "size", "nth")
    ends = found.groupBy(F.col("source").alias("_source")).agg(
        F.floor(F.max(F.col("goal") / F.col("source_size"))).cast("int").alias("_passes"), F.max(F.when(at, end)).alias("_end")
    )
    ends = F.broadcast(checkpointed(ends))
    keyed = docs.select("*", *row_key(docs)).join(ends, F.col("source").cast("string").eqNullSafe(F.col("_source")))
    earlier = F.lit(False)
    for x, y in reversed(list(zip(_order(), _order("_end.")))):
        earlier = (x < y) | ((x == y) & earlier)
    times = F.col("_passes") + F.when(F.coalesce(earlier, F.lit(False)), 1).otherwise(0)
    some = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    main = keyed.filter(some & (times > 0)).withColumn("_pass", F.explode(F.sequence(F.lit(1), times))).withColumn("_words", F.lit(None).cast("long"))
    # Of equal rows in which the pass ends, those before the end are taken whole once more, and one in part.
    last = keyed.filter(F.expr(" AND ".join(f"{k} = _end.{k}" for k in KEY))).dropDuplicates([*KEY])
    part = F.col("_end.rest") < F.col("_end.size")
    last = _each(last, F.col("_end.nth").cast("long"), "_pass")
    last = last.withColumn("_words", F.when(part & (F.col("_pass") == F.col("_end.nth")), F.col("_end.rest")))
    return main.union(last.select(*main.columns))


@own_names("doc_id", "text", "source", "n_chars")
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, budget: float | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; where a source's share ends inside a text, the words up to there."""
    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(_first_words(F.col("text"), F.col("_words")))
    out = _copies(docs, weights, repeats, budget).withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = F.when(F.col("_words").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", cut.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and how many of its words the mix takes."""
    found = plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.col("finish").alias("virtual_finish"))
