"""Pairs and encounters drawn by number, so that no pair is listed that is not drawn.

Points that agree in all that a granularity reads share a group: the place, one unit of time that both touch, and what both
know of the wild columns. A group's points are ordered by book and digest. Inside a group a point may meet the points of all
later books, so all points of one book and group have the same number of partners, and their possible pairs are a range of
numbers that follow from sums over groups. A number gives its group and book, the point in it and the partner's rank; only
groups that a number fell into are looked into, by cells (group, book, first two digits of the digest). What is drawn is
then checked: two ranges that share several units count in the first of them only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import check_granularity, location_condition, time_condition, unit_of
from ..functions.vocabulary import CANDIDATE_CAP, LOCATION_LEVELS
from ..sources.session import checkpointed
from . import encounters as E

CELL = ("g", "book_id", "bin")
IDS = ("event_id", "book_id", "character_id", "location_id", "point_role")
#: Digits of a digest that make a number below 2^52.
DIGITS, WHOLE = 13, 1 << 52
#: Encounters tried first; each further batch has four times as many, up to MOST.
TRIES, MOST = 64, 65_536


#: Groups up to which their table is sent to every task, and events up to which their texts are asked for by id.
SENT, ASKED = 1 << 19, 10_000
#: Bits of the number of points whose cells a task counts.
POINTS = 18


def _read(time: str, location: str) -> tuple[list[str], list[str], list[str]]:
    """The place level, if any, the wild columns, and all columns that tell groups apart."""
    place, wild = [] if location == "none" else [location], E._wild(time, location)
    return place, wild, [*place, "unit", "known", *[f"w_{c}" for c in wild]]


def matched(points: DataFrame, time: str, location: str, country: str | None = None) -> DataFrame:
    """Points that can meet others at this granularity, kept by a checkpoint with the columns that it reads."""
    check_granularity(time, location)
    place, wild, _ = _read(time, location)
    bounds = [] if time == "none" else ["y_start", "y_end"]
    own = E.in_country(points, country).dropna(subset=["book_id", *place, *bounds])
    return checkpointed(own.select(*IDS, *bounds, *[c for c in ("time_month", "time_day", *LOCATION_LEVELS) if c in (*place, *wild)]))


def _ranged(points: DataFrame, time: str, location: str, country: str | None) -> DataFrame:
    check_granularity(time, location)
    own = E.in_country(points, country).dropna(subset=["book_id", *([] if location == "none" else [location])])
    if time == "none":
        return own.select("*", *[F.lit(0).alias(c) for c in ("u_start", "u_end")])
    return own.dropna(subset=["y_start", "y_end"]).withColumns({u: unit_of(F.col(c), time) for u, c in (("u_start", "y_start"), ("u_end", "y_end"))})


def _each_unit() -> Column:
    return F.explode(F.sequence(F.least("u_start", "u_end"), F.greatest("u_start", "u_end")))


def spread(points: DataFrame, time: str, location: str, country: str | None = None) -> DataFrame:
    """A row for each unit of time that a point touches, with its digest d and its bin."""
    digest = F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "point_role").cast("binary"))
    rows = _ranged(points, time, location, country).withColumn("d", digest).withColumn("bin", F.substring("d", 1, 2))
    return rows.withColumn("unit", _each_unit())


def groups(points: DataFrame, time: str, location: str, country: str | None = None) -> DataFrame:
    """(g, what it stands for, book_id, n, seconds, before, past, w, weight): a book's points in both roles of a group, the ranks of seconds before and past it, the partners of each, and its pairs.

    Alike points are counted before they get a row for each group and role.
    """
    place, wild, key = _read(time, location)
    few = _ranged(points, time, location, country).groupBy("book_id", *place, *wild, "u_start", "u_end").agg(F.count("*").alias("m"))
    rows = E._meeting(few.withColumn("unit", _each_unit()), wild, [*place, "unit", "book_id"], ("m",))
    of = lambda role: F.sum(F.when(role, F.col("m")).otherwise(0))
    sums = rows.groupBy(*key, "book_id").agg(of(~F.col("second")).alias("n"), of(F.col("second")).alias("seconds"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sums = sums.withColumn("g", F.md5(F.concat_ws("|", *[text(c) for c in key]).cast("binary")))
    inside = Window.partitionBy("g")
    ranked = sums.select("*", F.sum("seconds").over(inside.orderBy("book_id")).alias("past"), F.sum("seconds").over(inside).alias("_all"))
    ranked = ranked.withColumn("w", F.col("_all") - F.col("past")).withColumn("before", F.col("past") - F.col("seconds")).drop("_all")
    return ranked.withColumn("weight", (F.col("n") * F.col("w")).cast("decimal(38,0)"))


def _of(rows: DataFrame, only: DataFrame, time: str, location: str, *more: str) -> DataFrame:
    """``rows`` of the groups (and books, and ``more``) in ``only``, which is sent to every task; adds what else it has."""
    key = [*_read(time, location)[2], "book_id", *more]
    renamed = only.select(*[F.col(c).alias(f"_{c}") if c in key else F.col(c) for c in only.columns])
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return rows.join(F.broadcast(renamed), same).drop(*[f"_{c}" for c in key])


def located(first: DataFrame, points: DataFrame, found: DataFrame, time: str, location: str, country: str | None = None) -> DataFrame:
    """Pairs (columns of both sides, draw) of draws ``first`` (draw, g, book_id, k, rank; bin, if k counts inside it); those that don't count are left out.

    k counts the points of a book in its group in the order of digests, rank the partners of the group. Of the rows only those
    of groups and books that a draw fell into are counted by bins, and only those of its bins are ranked.
    """
    place, wild, key = _read(time, location)
    only = found.select(*key, "g", "book_id")

    def rows(second: bool, *kept: str) -> DataFrame:
        own = spread(points, time, location, country)
        return E._meeting(own, wild, [*place, "unit", "book_id", "bin"], kept).filter(F.col("second") == second).drop("second")

    def binned(wanted: DataFrame, second: bool) -> DataFrame:
        """``wanted`` (draw, g, book_id, k) with the bin, and k counted inside it."""
        mine = only.join(F.broadcast(wanted.select("g", "book_id").distinct()), ["g", "book_id"], "left_semi")
        sums = _of(rows(second), mine, time, location).groupBy(*CELL).agg(F.count("*").alias("_n"))
        sums = sums.withColumn("_past", F.sum("_n").over(Window.partitionBy("g", "book_id").orderBy("bin")))
        within = (F.col("k") < F.col("_past")) & (F.col("k") >= F.col("_past") - F.col("_n"))
        return sums.join(F.broadcast(wanted), ["g", "book_id"]).filter(within).select("draw", *CELL, (F.col("k") - F.col("_past") + F.col("_n")).alias("k"))

    def side(wanted: DataFrame, second: bool, s: str) -> DataFrame:
        mine = only.join(F.broadcast(wanted.select(*CELL).distinct()), ["g", "book_id"])
        order = Window.partitionBy(*CELL).orderBy("d", "event_id", "point_role", "location_id", "character_id")
        kept = [c for c in IDS if c != "book_id"] + ["u_start", "u_end", "d"]
        ranked = _of(rows(second, *kept), mine, time, location, "bin").withColumn("k", F.row_number().over(order).cast("long") - 1)
        got = ranked.join(F.broadcast(wanted), [*CELL, "k"])
        return got.select("draw", *[F.col(c).alias(f"{c}_{s}") for c in (*IDS, "unit", "u_start", "u_end")])

    # The partner's book is that which holds its rank.
    ranges = found.filter("seconds > 0").select("g", F.col("book_id").alias("book"), "before", "seconds")
    then = ranges.join(F.broadcast(first.select("draw", "g", "rank")), "g").filter("rank >= before AND rank < before + seconds")
    then = checkpointed(then.select("draw", "g", F.col("book").alias("book_id"), (F.col("rank") - F.col("before")).alias("k")))
    own = first.select("draw", *CELL, "k") if "bin" in first.columns else binned(first.select("draw", "g", "book_id", "k"), False)
    both = side(checkpointed(own), False, "a").join(side(checkpointed(binned(then, True)), True, "b"), "draw")
    if time == "none":
        return both
    return both.filter("unit_a = greatest(u_start_a, u_start_b) AND u_start_a <= u_end_b AND u_start_b <= u_end_a")


def _split(draws: DataFrame) -> DataFrame:
    """Draws of a pair number ``at`` of a book's points in a group: k, the point's number, and rank, its partner's."""
    wide = draws.withColumn("_w", F.col("w").cast("decimal(38,0)"))
    return wide.withColumn("k", F.expr("at div _w").cast("long")).withColumn("rank", F.col("past") + F.expr("at % _w").cast("long")).drop("_w", "w", "past", "at")


def number(text: str) -> int:
    """A number below 2^52 drawn by a digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def skips(keep: float) -> float:
    """What the log of a drawn number is divided by to give how many pairs are passed over."""
    return math.log(1 - keep) if keep > 1e-6 else math.log1p(-keep)


def bernoulli_pairs(points: DataFrame, time: str = "year", location: str = "city", country: str | None = None, seed: int = 0, cap: int = CANDIDATE_CAP) -> DataFrame:
    """All pairs, or above ``cap`` each with probability cap / their number, independently (a sampling operator).

    A cell's pairs are passed over in geometric steps, so the work follows what is kept, however many pairs there are.
    """
    own = matched(points, time, location, country)
    count = E.pair_count(own, time, location).first()["n"]
    if count <= cap:
        return E.pairs(points, time, location, country)
    by, found = skips(cap / count), checkpointed(groups(own, time, location))
    place, wild, key = _read(time, location)
    # A bin of a place and unit has all rows of its cells, so that points are sent once, before they get a row for each group.
    # Their number follows the points, so that no task counts more of them on larger tables.
    parts = max(8, own.count() >> POINTS)
    rows = spread(own, time, location).select("book_id", *place, *wild, "unit", "bin").repartition(parts, *place, "unit", "bin")
    cells = E._meeting(rows, wild, [*place, "unit", "book_id", "bin"], ()).filter("NOT second").groupBy(*key, "book_id", "bin").agg(F.count("*").alias("n"))
    some = found.filter("weight > 0").select(*[F.col(c).alias(f"_{c}") for c in (*key, "book_id")], "g", "w")
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, "book_id")])
    cells = cells.join(F.broadcast(some) if some.count() <= SENT else some, same)
    cells = cells.withColumn("weight", (F.col("n") * F.col("w")).cast("decimal(38,0)"))
    text = F.concat_ws("|", F.lit(str(seed)), "g", F.col("book_id").cast("string"), "bin", F.lit("0"))
    x = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    start = F.floor(F.log((x + 0.5) / WHOLE) / by)
    # Most cells keep nothing, which their first step shows.
    some = cells.withColumn("at", start.cast("decimal(38,0)")).filter("at < weight")
    some = some.select(*CELL, F.col("book_id").cast("string").alias("book"), F.col("at").cast("string").alias("at"), F.col("weight").cast("string").alias("weight"))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                at, most, k = int(r["at"]), int(r["weight"]), 0
                while at < most:
                    out.append((r["g"], r["book_id"], r["bin"], str(at)))
                    k += 1
                    u = (number(f"{seed}|{r['g']}|{r['book']}|{r['bin']}|{k}") + 0.5) / WHOLE
                    at += 1 + math.floor(math.log(u) / by)
            yield pd.DataFrame(out, columns=["g", "book_id", "bin", "at"])

    draws = some.mapInPandas(steps, f"g string, book_id {found.schema['book_id'].dataType.simpleString()}, bin string, at string")
    # Numbers of draws only tell rows apart; checkpointed, so that both sides see the same.
    draws = checkpointed(draws.withColumn("draw", F.monotonically_increasing_id()))
    at = found.select("g", "book_id", "w", "past").join(F.broadcast(draws.withColumn("at", F.col("at").cast("decimal(38,0)"))), ["g", "book_id"])
    return located(checkpointed(_split(at)), own, found, time, location).select(*[f"{c}_{s}" for s in "ab" for c in IDS])


def _numbered(found: DataFrame) -> DataFrame:
    """Groups with ``start``, the number of their first pair, in the order of groups and books; sums in two levels."""
    wide = found.withColumn("part", F.substring("g", 1, 3))
    parts = wide.groupBy("part").agg(F.sum("weight").alias("_sum"))  # 4,096 rows at most
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("weight").over(earlier(Window.partitionBy("part").orderBy("g", "book_id"))), F.lit(0))
    return wide.withColumn("_in", inside).join(F.broadcast(parts), "part").withColumn("start", (F.col("_base") + F.col("_in")).cast("decimal(38,0)")).drop("_base", "_in")


def drawn_pairs(points: DataFrame, time: str, location: str, country: str | None, numbers: Iterator[tuple[int, int]], state: tuple | None = None) -> tuple[DataFrame | None, tuple]:
    """Pairs of given draws (draw, number below 2^52 of the pairs' range), and what can be used for the next ones."""
    if state is None:
        found = checkpointed(_numbered(groups(points, time, location, country)))
        state = (found, int(found.agg(F.sum("weight")).first()[0] or 0))
    found, total = state
    if not total:
        return None, state
    spark = points.sparkSession
    draws = spark.createDataFrame([(i, str(n * total // WHOLE)) for i, n in numbers], "draw long, t string").withColumn("t", F.col("t").cast("decimal(38,0)"))
    parts = found.filter("weight > 0").groupBy("part").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("weight")).alias("hi"))
    draws = draws.join(F.broadcast(parts), (F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi"))).drop("lo", "hi")
    hit = found.join(F.broadcast(draws), "part").filter("t >= start AND t < start + weight")
    hit = checkpointed(_split(hit.select("draw", "g", "book_id", "w", "past", (F.col("t") - F.col("start")).alias("at"))))
    return located(hit, points, found, time, location, country), state


SHOWN = ("readable_location", "readable_time")


def _texts(readable: DataFrame, events: DataFrame) -> DataFrame:
    """``readable`` of the given events; few are asked for by their ids, which Spark hands down to what is read."""
    ids = events.select("event_id").distinct()
    few = [r[0] for r in ids.limit(ASKED + 1).collect()]
    return readable.filter(F.col("event_id").isin(few)) if len(few) <= ASKED else readable.join(ids, "event_id", "left_semi")


def _supports(drawn: DataFrame, points: DataFrame, readable: DataFrame, time: str, location: str) -> DataFrame:
    """``drawn`` (draw, ids of both sides) with support_count: the point pairs of the encounter that each belongs to."""
    reads = [c for c in E.POINT if c in points.columns]
    drawn = checkpointed(drawn)
    people = [drawn.select(*[F.col(f"{c}_{s}").alias(c) for c in ("book_id", "character_id")]) for s in "ab"]
    people = people[0].union(people[1]).distinct()
    # The points of the drawn characters, and what is shown of them.
    near = checkpointed(points.select("event_id", "character_id", *reads).join(F.broadcast(people), ["book_id", "character_id"]))
    texts = checkpointed(_texts(readable, near).select("event_id", *SHOWN))
    own = drawn
    for s in "ab":
        own = own.join(texts.select(F.col("event_id").alias(f"event_id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in SHOWN]), f"event_id_{s}")
    own = checkpointed(own)

    def units(s: str) -> DataFrame:
        """Alike points of the side's character that show what the drawn one shows."""
        who = own.select("draw", *[F.col(f"{c}_{s}").alias(c) for c in ("book_id", "character_id")], *[F.col(f"{c}_{s}").alias(f"_{c}") for c in SHOWN])
        mine = near.join(texts, "event_id").join(F.broadcast(who), ["book_id", "character_id"])
        alike = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SHOWN])
        return mine.filter(alike).groupBy("draw", *reads).agg(F.count("*").alias("m"))

    cond = (F.col("a.draw") == F.col("b.draw")) & location_condition(location) & time_condition(time)
    sums = units("a").alias("a").join(units("b").alias("b"), cond).groupBy("a.draw").agg(F.sum(F.col("a.m") * F.col("b.m")).alias("support_count"))
    return own.join(sums, "draw")


def random_encounter(points: DataFrame, readable: DataFrame, time: str, location: str, country: str | None = None, seed: int = 0) -> DataFrame:
    """One encounter, all equally likely, so that characters with many events are not preferred; no row if there is none.

    A pair is drawn among all pairs and taken with probability 1 / the pairs of its encounter, else the next one is tried.
    """
    own, lo, hi, state = matched(points, time, location, country), 0, TRIES, None
    while True:
        drawn, state = drawn_pairs(own, time, location, None, ((i, number(f"{seed}|{i}")) for i in range(lo, hi)), state)
        if drawn is None:
            return E._shown(_none(points), readable)
        tried = checkpointed(_supports(drawn, own, readable, time, location))
        take = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|take"), F.col("draw").cast("string")).cast("binary")), 1, DIGITS), 16, 10).cast("double") / WHOLE
        taken = tried.filter(take * F.col("support_count") < 1).orderBy("draw").limit(1)
        taken = checkpointed(taken.select("character_id_a", "character_id_b", "event_id_a", "event_id_b", "support_count"))
        if not taken.isEmpty():
            events = taken.select(F.explode(F.array("event_id_a", "event_id_b")).alias("event_id"))
            return E._shown(taken, _texts(readable, events))
        lo, hi = hi, hi + min(4 * (hi - lo), MOST)
        if lo > TRIES and _impossible(own, time, location):
            return E._shown(_none(points), readable)


def _impossible(points: DataFrame, time: str, location: str) -> bool:
    """No pair counts, though some were possible: ranges that end before they begin."""
    return not E.pair_count(points, time, location).first()["n"]


def _none(points: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"{c}_{s} {kinds[c]}" for c in ("character_id", "event_id") for s in "ab")
    return points.sparkSession.createDataFrame([], f"{schema}, support_count long")
