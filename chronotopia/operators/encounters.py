"""The flagship: characters of different books in the same place at the same time.

Plans: with a place level, its equality is a hash-join key; with a time granularity, points are put in buckets of years
and the bucket is a key too, so no nested loop is planned. Counting lists no pairs: it takes sums over years and is linear
in the distinct points, at any granularity. Groups join points that are alike only once, with their number, and text is
attached to the groups. Listing all pairs without any restriction is a nested loop by its nature; the cap and the random
encounter list none, see ``sampling``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import UNIT, alike, check_granularity, location_condition, time_condition, unit_of
from ..functions.vocabulary import CONTINENTS, LOCATION_LEVELS
from ..sources.session import checkpointed, let_go

#: Units (years, decades or centuries) in a bucket of the time join.
BUCKET = {"year": 4, "month": 4, "day": 4, "decade": 1, "century": 1}
POINT = ("book_id", "y_start", "y_end", "time_month", "time_day", *LOCATION_LEVELS)


def in_country(points: DataFrame, country: str | None) -> DataFrame:
    """Both sides in this country (folded to compare); before the join."""
    return points if country is None else points.filter(F.col("country") == country.strip().lower())


def _bucketed(points: DataFrame, time: str) -> DataFrame:
    """A row for each bucket that the point's years touch; points without a bound match at no granularity."""
    first, last = (F.floor(unit_of(F.col(c), time) / float(BUCKET[time])).cast("int") for c in ("y_start", "y_end"))
    known = points.filter("y_start IS NOT NULL AND y_end IS NOT NULL").withColumn("first", first).withColumn("last", last)
    return known.withColumn("bucket", F.explode(F.sequence(F.least("first", "last"), F.greatest("first", "last"))))


def _known(points: DataFrame, location: str, side: str) -> DataFrame:
    """``points`` for each set of coarser levels that the other side may know; those that agree share known and w_*."""
    wild = LOCATION_LEVELS[: LOCATION_LEVELS.index(location)] if location != "none" else ()
    own = sum((F.when(F.col(c).isNotNull(), 1 << n).otherwise(0) for n, c in enumerate(wild)), F.lit(0))
    rows = points.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit((1 << len(wild)) - 1))))
    first, then = ("_own", "_other") if side == "a" else ("_other", "_own")
    both = F.col("_own").bitwiseAND(F.col("_other"))
    rows = rows.withColumns({f"w_{c}": F.when(both.bitwiseAND(F.lit(1 << n)) != 0, F.col(c)).otherwise("") for n, c in enumerate(wild)})
    return rows.withColumn("known", F.col(first) * (1 << len(wild)) + F.col(then)).drop("_own", "_other")


def _joined(points: DataFrame, time: str, location: str, other: DataFrame | None = None, more: Column | None = None) -> DataFrame:
    """Pairs (a, b) of points, a of ``points`` and b of ``other`` (by default the same); ``more`` is a further condition.

    Coarser levels agree by equality of keys, once for each set of them that both sides know, so that a place which few
    know is not compared with all others of its level.
    """
    check_granularity(time, location)
    other = points if other is None else other
    cond = (F.col("a.book_id") < F.col("b.book_id")) & time_condition(time)
    if location != "none":
        points, other = (_known(side.filter(F.col(location).isNotNull()), location, s) for s, side in (("a", points), ("b", other)))
        for c in (location, "known", *[f"w_{c}" for c in LOCATION_LEVELS[: LOCATION_LEVELS.index(location)]]):
            cond = (F.col(f"a.{c}") == F.col(f"b.{c}")) & cond
    if time in UNIT:
        points, other = _bucketed(points, time), _bucketed(other, time)
        # Two ranges share several buckets; they meet in the first of them.
        cond = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.bucket") == F.greatest("a.first", "b.first")) & cond
    return points.alias("a").join(other.alias("b"), cond if more is None else more & cond)


#: Points of a list at most: two lists that meet give up to its square of pairs at once.
LIST = 64
IDS = ("event_id", "character_id", "location_id", "point_role")


def _both_known(points: DataFrame, location: str) -> DataFrame:
    """As ``_known``, but for both sides at once: with the levels that a row knows (_own) and those that the other side may know (_other)."""
    wild = LOCATION_LEVELS.index(location)
    rows = _known(points, location, "a").withColumns({"_own": F.shiftright("known", wild), "_other": F.col("known").bitwiseAND(F.lit((1 << wild) - 1))})
    return rows.withColumn("known", F.least("_own", "_other") * (1 << wild) + F.greatest("_own", "_other"))


def _dealt(lists: DataFrame, keys: list[str]) -> DataFrame:
    """``lists`` by ``keys`` to a fixed number of tasks: few lists may give many pairs, so their size says little of the work."""
    spark = lists.sparkSession
    return lists.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _meet(location: str, keys: list[str]) -> Column:
    """That two rows dealt by ``keys`` are of one place and of books in order."""
    cond = reduce(lambda p, q: p & q, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]) & (F.col("a.book_id") < F.col("b.book_id"))
    if location != "none":
        # No keys: these would have both sides dealt again. Both columns of both sides are named, so that one deal serves both.
        cond = cond & (F.col("a._own") - F.col("b._other") == 0) & (F.col("a._other") - F.col("b._own") == 0)
    return cond


def _lists(points: DataFrame, time: str, location: str, keys: list[str], kept: list[str]) -> DataFrame:
    """``points`` as lists (items: ``kept``) of at most LIST that share a place, a bucket of years, a book and bounds.

    ``keys`` are what two lists must share to meet; by them the lists are dealt, once for both sides of the join. A list
    is of points with the coarser levels _own which meet those with _other; known is the same for both.
    """
    rows, group = points, [*keys, "book_id"]
    if location != "none":
        rows = _both_known(points.filter(F.col(location).isNotNull()), location)
        group += ["_own", "_other"]
    if time in UNIT:
        rows = _bucketed(rows, time)
        group += ["first", "y_start", "y_end"]
    number = F.row_number().over(Window.partitionBy(*group).orderBy(kept[0]))
    rows = rows.select(*group, F.floor((number - 1) / F.lit(LIST)).alias("_list"), F.struct(*kept).alias("item"))
    return _dealt(rows.groupBy(*group, "_list").agg(F.collect_list("item").alias("items")).drop("_list"), keys)


def pairs(points: DataFrame, time: str = "year", location: str = "city", country: str | None = None) -> DataFrame:
    """Pairs of match points of different books, each pair once: ids of both sides.

    Lists of points are joined, not points: what decides is looked at once for two lists, months and days excepted, and all
    their pairs are written out where they meet. Each side is as large as the points, only the rows returned grow with their square.
    """
    check_granularity(time, location)
    own = in_country(points, country).select(*IDS, *POINT).filter("book_id IS NOT NULL")
    ids = [(c, s) for s in "ab" for c in ("event_id", "book_id", "character_id", "location_id", "point_role")]
    keys = [] if location == "none" else [location, "known", *[f"w_{c}" for c in LOCATION_LEVELS[: LOCATION_LEVELS.index(location)]]]
    keys += ["bucket"] if time in UNIT else []
    if not keys:
        return _joined(own, time, location).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c, s in ids])
    dated = {"month": ["time_month"], "day": ["time_month", "time_day"]}.get(time, [])
    lists = _lists(own, time, location, keys, [*IDS, *dated])
    cond = _meet(location, keys)
    if time in UNIT:
        # Two ranges share several buckets; they meet in the first of them.
        cond = cond & (F.col("a.bucket") == F.greatest("a.first", "b.first")) & time_condition("year" if dated else time)
    met = lists.alias("a").join(lists.alias("b"), cond).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("book_id", "items")])
    for s in "ab":
        met = met.select("*", F.inline(f"items_{s}").alias(*[f"{c}_{s}" for c in (*IDS, *dated)])).drop(f"items_{s}")
    for c in dated:
        met = met.filter(alike(F.col(f"{c}_a"), F.col(f"{c}_b")))
    return met.select(*[f"{c}_{s}" for c, s in ids])


def _wild(time: str, location: str) -> list[str]:
    """Columns in which an unknown value agrees with anything."""
    levels = list(LOCATION_LEVELS[: LOCATION_LEVELS.index(location)]) if location != "none" else []
    return levels + {"month": ["time_month"], "day": ["time_month", "time_day"]}.get(time, [])


def _meeting(points: DataFrame, wild: list[str], keys: list[str], kept: tuple[str, ...] = ("y_start", "y_end", "m")) -> DataFrame:
    """``points`` for each set of wild columns that the other side may know, in both roles: points that agree share keys, known and w_*."""
    own = sum((F.when(F.col(c).isNotNull(), 1 << n).otherwise(0) for n, c in enumerate(wild)), F.lit(0))
    rows = points.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit((1 << len(wild)) - 1)))).withColumn("second", F.explode(F.array(F.lit(False), F.lit(True))))
    first, then = F.when(F.col("second"), F.col("_other")).otherwise(F.col("_own")), F.when(F.col("second"), F.col("_own")).otherwise(F.col("_other"))
    both = F.col("_own").bitwiseAND(F.col("_other"))
    shared = [F.when(both.bitwiseAND(F.lit(1 << n)) != 0, F.col(c)).alias(f"w_{c}") for n, c in enumerate(wild)]
    return rows.select(*keys, (first * (1 << len(wild)) + then).alias("known"), *shared, "second", *kept)


def pair_count(points: DataFrame, time: str = "year", location: str = "city", country: str | None = None) -> DataFrame:
    """One row: n, the number of pairs, without listing them.

    Of all ordered pairs of points that agree in place (and month and day) those are taken off in which one ends before the
    other begins, which prefix sums over the years give; then the same inside each book, which leaves every pair of books
    twice. Ranges that end before they begin are few at most: pairs in which each ends before the other begins need one.
    """
    check_granularity(time, location)
    own, place, wild = in_country(points, country).filter("book_id IS NOT NULL"), [] if location == "none" else [location], _wild(time, location)
    if place:
        own = own.filter(F.col(location).isNotNull())
    if time == "none":
        own = own.withColumn("y_start", F.lit(0)).withColumn("y_end", F.lit(0))
    else:
        own = own.filter("y_start IS NOT NULL AND y_end IS NOT NULL")
        own = own.withColumns({c: unit_of(F.col(c), time) for c in ("y_start", "y_end")})
    few = own.groupBy("book_id", *place, *wild, "y_start", "y_end").agg(F.count("*").alias("m"))
    # Once over all books (a null one), once in each.
    few = few.withColumn("book", F.explode(F.array(F.lit(None).cast(own.schema["book_id"].dataType), F.col("book_id")))).drop("book_id")
    keys, group = ["book", *place], ["book", *place, "known", *[f"w_{c}" for c in wild]]
    wide = lambda c: c.cast("decimal(38,0)")
    rows = _meeting(few, wild, keys)
    at = F.when(F.col("second"), F.col("y_start")).otherwise(F.col("y_end")).alias("at")
    years = rows.groupBy(*group, at).agg(F.sum(F.when(~F.col("second"), F.col("m")).otherwise(0)).alias("ends"), F.sum(F.when(F.col("second"), F.col("m")).otherwise(0)).alias("starts"))
    w = Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("ends").over(w), F.lit(0))
    sums = years.withColumn("apart", wide(F.col("starts")) * wide(before)).groupBy(*group).agg(F.sum("ends").alias("a"), F.sum("starts").alias("b"), F.sum("apart").alias("apart"))
    sign = F.when(F.col("book").isNull(), 1).otherwise(-1)
    total = sums.agg(F.sum(wide(sign) * (wide(F.col("a")) * wide(F.col("b")) - 2 * F.col("apart"))).alias("n"))
    if time != "none":
        odd = _meeting(few.filter("y_start > y_end"), wild, keys).filter("second").alias("b")
        same = reduce(lambda p, q: p & q, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group])
        both = rows.filter("NOT second").alias("a").join(odd, same & F.expr("a.y_end < b.y_start AND b.y_end < a.y_start"))
        part = F.when(F.expr("a.y_start > a.y_end"), 1).otherwise(2) * F.when(F.col("a.book").isNull(), 1).otherwise(-1)
        total = total.union(both.agg(F.sum(wide(part) * wide(F.col("a.m") * F.col("b.m"))).alias("n")))
    return total.agg((F.coalesce(F.sum("n"), F.lit(0)) / 2).cast("long").alias("n"))


SIDE = ("character_name", "book_title", "readable_location", "readable_time", "evidence_quote", "location_type", "country", "region", "city", "transit_to_country", "transit_to_city")
NAMES = ("character", "book", "location", "time", "evidence", "location_type", "country", "region", "city", "transit_to_country", "transit_to_city")


def _numbered(readable: DataFrame) -> DataFrame:
    """(event_id, shown_as): events that show the same place and time have one number."""
    shown = readable.select("event_id", "readable_location", "readable_time")
    alike = shown.groupBy("readable_location", "readable_time").agg(F.min("event_id").alias("shown_as"))
    same = F.col("s.readable_location").eqNullSafe(F.col("n.readable_location")) & F.col("s.readable_time").eqNullSafe(F.col("n.readable_time"))
    return shown.alias("s").join(alike.alias("n"), same).select("s.event_id", "n.shown_as")


def _shown(groups: DataFrame, readable: DataFrame) -> DataFrame:
    """``groups`` with what is shown of both events."""
    for s in "ab":
        groups = groups.join(readable.select(F.col("event_id").alias(f"event_id_{s}"), *[F.col(c).alias(f"{n}_{s}") for c, n in zip(SIDE, NAMES)]), f"event_id_{s}")
    both = [f"{n}_{s}" for s in "ab" for n in NAMES]
    return groups.select("character_id_a", "character_id_b", "event_id_a", "event_id_b", *both, "support_count")


#: Units of a side up to which a pair of sides is judged where two of its units meet; others are grouped.
LISTED = 16
#: Pairs of sides, at any place and time, that may be looked at first when only the most supported groups are asked for.
FIRST_PAIRS = 1 << 22


#: What is shown of an event besides the place and time of its side.
REST = tuple((c, n) for c, n in zip(SIDE, NAMES) if c not in ("readable_location", "readable_time"))


def _units(points: DataFrame, readable: DataFrame, time: str, location: str, country: str | None, shown: bool = False) -> DataFrame:
    """Points of a side (a character and what is shown of place and time) that agree in all that the predicate reads, as units.

    A row has its side (its least event), k, the unit's number in it, m points and the least event; with ``shown`` also what is
    shown of that event (_location, _time and rest). n counts the side's units and all lists them, null of one unit alone or of over LISTED; plain says that each lies in a place of its own, elsewhere lists the other places; top and total are the points of the side in its fullest place and in all.
    """
    own = in_country(points, country).filter("book_id IS NOT NULL")
    reads = [] if time == "none" else ["y_start", "y_end", *{"month": ["time_month"], "day": ["time_month", "time_day"]}.get(time, [])]
    levels = [] if location == "none" else list(LOCATION_LEVELS[: LOCATION_LEVELS.index(location) + 1])
    for c in [*reads[:2], *levels[-1:]]:
        own = own.filter(F.col(c).isNotNull())
    side, reads = ["book_id", "character_id", "readable_location", "readable_time"], [*reads, *levels]
    rest = [F.struct(*[F.col(c).alias(n) for c, n in REST]).alias("rest")] if shown else []
    named = own.select("event_id", *side[:2], *reads).join(readable.select("event_id", *side[2:], *rest), "event_id")
    # Dealt by sides once; units, places and sides are formed where they lie.
    units = named.repartition(*side).groupBy(*side, *reads).agg(F.count("*").alias("m"), F.min("event_id").alias("event_id"), *[F.min_by("rest", "event_id").alias("rest") for _ in rest])
    place = F.sum("m").over(Window.partitionBy(*side, *levels[-1:])).alias("here")
    own = ["event_id", "m", *reads]
    units = units.select("*", place).groupBy(*side).agg(
        F.array_sort(F.collect_list(F.struct(*own, *["rest" for _ in rest]))).alias("units"), F.min("event_id").alias("side"), F.max("here").alias("top"), F.sum("m").alias("total")
    )
    known = F.transform("units", lambda u: F.struct(*[u[c].alias(c) for c in own]))
    both = [F.col("readable_location").alias("_location"), F.col("readable_time").alias("_time")] if shown else []
    sums = [] if shown else ["top", "total"]
    rows = units.select("book_id", "character_id", "side", *sums, *both, F.size("units").alias("n"), F.when(F.size("units").between(2, LISTED), known).alias("all"), F.posexplode("units").alias("k", "u"))
    at = lambda u: u[levels[-1]] if levels else F.lit("")
    places = F.transform("all", at)
    plain, elsewhere = (F.col("n") == 1) | (F.size(F.array_distinct(places)) == F.col("n")), F.filter(places, lambda p: p != at(F.col("u")))
    return checkpointed(rows.select("book_id", "character_id", "side", *sums, *[c for c in ("_location", "_time") if shown], "n", "all", plain.alias("plain"), elsewhere.alias("elsewhere"), "k", "u.*"))


def _unit_pairs(units: DataFrame, time: str, location: str) -> DataFrame:
    """As ``_joined`` of ``units`` with themselves: structs a and b.

    Units are sent once, for each place and bucket of years, whichever levels they know. There they make lists of at most LIST
    that share a book and the coarser levels; lists are compared by these, units by their years.
    """
    check_granularity(time, location)
    wild = [] if location == "none" else list(LOCATION_LEVELS[: LOCATION_LEVELS.index(location)])
    keys = [] if location == "none" else [location]
    rows = units
    if time in UNIT:
        rows, keys = _bucketed(units, time), [*keys, "bucket"]
    if not keys:
        a, b = ([F.col(f"{s}.{c}") for c in units.columns] for s in "ab")
        return _joined(units, time, location).select(F.struct(*a).alias("a"), F.struct(*b).alias("b"))
    group = [*keys, "book_id", *wild]
    rows = _dealt(rows, keys)
    number = F.row_number().over(Window.partitionBy(*group).orderBy("side", "k"))
    rows = rows.select(*group, F.floor((number - 1) / F.lit(LIST)).alias("_list"), F.struct(*[c for c in rows.columns if c not in ("top", "total", "last", "bucket")]).alias("item"))
    lists = rows.groupBy(*group, "_list").agg(F.collect_list("item").alias("items")).drop("_list")
    cond = reduce(lambda p, q: p & q, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys] + [alike(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in wild])
    # Coalesced, so that no filter of nulls is put on one side only: one deal serves both.
    cond = cond & F.coalesce(F.col("a.book_id") < F.col("b.book_id"), F.lit(False))
    met = lists.alias("a").join(lists.alias("b"), cond).select(*[F.col("a.bucket") for c in keys if c == "bucket"], F.col("a.items").alias("items_a"), F.col("b.items").alias("items_b"))
    met = met.withColumn("a", F.explode("items_a")).drop("items_a").withColumn("b", F.explode("items_b")).drop("items_b")
    if time in UNIT:
        # Two ranges share several buckets; they meet in the first of them.
        met = met.filter((F.col("bucket") == F.greatest("a.first", "b.first")) & time_condition(time))
    return met.select("a", "b")


def _grouped(units: DataFrame, time: str, location: str, readable: DataFrame | None = None, other: DataFrame | None = None, more: Column | None = None) -> DataFrame:
    """Groups of ``units`` and ``other``: ids, least events and support_count; with ``readable`` also what is shown, which the units must carry.

    A pair of sides is judged from their lists wherever two of its units meet, and is given at the least pair of units that
    meet, so that no pairs are shuffled or gathered. Only pairs with a side of too long a list are grouped.
    """
    ids = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("character_id", "event_id") for s in "ab"]
    found = _unit_pairs(units, time, location) if other is None else _joined(units, time, location, other, more)
    long = (F.col("a.n") > LISTED) | (F.col("b.n") > LISTED)
    some = not units.filter(F.col("n") > LISTED).isEmpty()
    if some:
        # Pairs of long sides lie in few tasks, by their place, and are summed there before they are sent.
        rows = found.filter(long).select(*ids, *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("side", "m") for s in "ab"])
        one = F.min(F.struct("event_id_a", "event_id_b")).alias("one")
        groups = rows.groupBy("character_id_a", "character_id_b", "side_a", "side_b").agg(F.sum(F.col("m_a") * F.col("m_b")).alias("support_count"), one)
        groups = groups.select("character_id_a", "character_id_b", "one.event_id_a", "one.event_id_b", "support_count")
        apart = groups if readable is None else _shown(groups, readable)
        found = found.filter(~long)
    meets = lambda u, v: time_condition(time, u, v) & location_condition(location, u, v)
    own = units.schema["all"].dataType.elementType.names
    listed = lambda side: F.coalesce(F.col(f"{side}.all"), F.array(F.struct(*[F.col(f"{side}.{c}").alias(c) for c in own])))
    number = lambda side: F.transform(listed(side), lambda u, k: F.struct(k.alias("k"), u.alias("u")))
    met = F.flatten(F.transform(number("a"), lambda x: F.transform(
        F.filter(number("b"), lambda y: meets(x["u"], y["u"])),
        lambda y: F.struct(x["u"]["event_id"].alias("event_id_a"), y["u"]["event_id"].alias("event_id_b"), x["k"].alias("k_a"), y["k"].alias("k_b"), (x["u"]["m"] * y["u"]["m"]).alias("n")),
    )))
    # Sides whose units lie in places of their own, of which they share this one only, have no other pair of units that meets.
    single = (F.col("a.n") == 1) | (F.col("b.n") == 1) | ~F.arrays_overlap("a.elsewhere", "b.elsewhere")
    alone = F.col("a.plain") & F.col("b.plain") & single
    # The least pair of units is judged where it meets; its support is the sum over all that meet.
    least = F.array_min(met)
    here = (least["k_a"] == F.col("a.k")) & (least["k_b"] == F.col("b.k"))
    support = F.aggregate(met, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    # A list of one support or none: what generates rows is no filter, so the join's own conditions are looked at before it.
    given = F.when(alone, F.array(F.col("a.m") * F.col("b.m"))).when(here, F.array(support)).otherwise(F.array().cast("array<bigint>"))
    shown = lambda n, s: F.col(f"{s}._{n}" if n in ("location", "time") else f"{s}.rest.{n}").alias(f"{n}_{s}")
    both = [] if readable is None else [shown(n, s) for s in "ab" for n in NAMES]
    given = found.select(*ids, *both, F.explode(given).alias("support_count"))
    return given.unionByName(apart) if some else given


def encounters(points: DataFrame, readable: DataFrame, time: str = "year", location: str = "city", country: str | None = None) -> DataFrame:
    """Pairs grouped by characters and what is shown of both places and times; support_count counts point pairs.

    The row shown for a group is that of the least events. Texts come to the units, and pairs are given as they are joined.
    """
    units = _units(points, readable, time, location, country, True)
    let_go(points.sparkSession)
    return _grouped(units, time, location, readable)


def most_supported(points: DataFrame, readable: DataFrame, time: str = "year", location: str = "city", country: str | None = None, limit: int = 25) -> DataFrame:
    """The first rows of ``encounters`` by support_count (descending) and least events, without listing all groups.

    Two sides share no more pairs than the points of one in its fullest place times all of the other. Sides fall into
    classes by these numbers, and pairs of classes are joined from the greatest bound down, until ``limit`` groups have as
    much support as the least bound joined; all other groups have less.
    """
    up = lambda c: F.when(F.col(c) <= 16, F.col(c)).otherwise(F.greatest(F.col(c), F.ceil(F.pow(F.lit(2.0), F.ceil(F.log2(F.col(c).cast("double")) * 4) / 4))))
    units = _units(points, readable, time, location, country).withColumn("class", F.struct(up("top").cast("long").alias("top"), up("total").cast("long").alias("total")))
    sizes = {tuple(r[0]): r[1] for r in units.filter("k = 0").groupBy("class").count().collect()}
    bounds = sorted(((min(x[0] * y[1], x[1] * y[0]), x, y) for x in sizes for y in sizes), reverse=True)
    schema = units.select("class", F.col("class").alias("want")).schema
    order = (F.desc("support_count"), "event_id_a", "event_id_b")
    allowed, need, done = FIRST_PAIRS, 0, False
    while not done:
        total = taken = 0
        while taken < len(bounds) and (not taken or bounds[taken][0] == bounds[taken - 1][0] or bounds[taken][0] >= need > 0 or total + sizes[bounds[taken][1]] * sizes[bounds[taken][2]] <= allowed):
            total += sizes[bounds[taken][1]] * sizes[bounds[taken][2]]
            taken += 1
        chosen = units.sparkSession.createDataFrame([(x, y) for _, x, y in bounds[:taken]], schema)
        wanting = units.join(F.broadcast(chosen), "class")
        best = checkpointed(_grouped(wanting, time, location, None, units, F.col("a.want") == F.col("b.class")).orderBy(*order).limit(limit))
        supports = [r[0] for r in best.select("support_count").collect()]
        done = taken == len(bounds) or (len(supports) == limit and min(supports) > bounds[taken][0])
        need, allowed = min(supports) if len(supports) == limit else 0, allowed * 16
    return _shown(best, readable).orderBy(*order)


def encounter_groups(found: DataFrame, readable: DataFrame, order: Column) -> DataFrame:
    """As ``encounters``, of given pairs; the row shown for a group is the one least by ``order``, a column of the pairs."""
    numbers, rows = _numbered(readable), found.withColumn("r", order)
    for s in "ab":
        rows = rows.join(numbers.toDF(f"event_id_{s}", f"shown_as_{s}"), f"event_id_{s}")
    one = F.min_by(F.struct("event_id_a", "event_id_b"), F.struct("r", "event_id_a", "event_id_b")).alias("one")
    groups = rows.groupBy(*[f"{c}_{s}" for c in ("book_id", "character_id", "shown_as") for s in "ab"]).agg(F.count("*").alias("support_count"), one)
    return _shown(groups.select("character_id_a", "character_id_b", "one.event_id_a", "one.event_id_b", "support_count"), readable)


PAIR = ("event_id_a", "point_role_a", "event_id_b", "point_role_b")


def drawn(seed: int, *cols: str) -> Column:
    """A number from 0 up to 2^32, drawn by a digest of the columns: the same at every run and in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def encounter(points: DataFrame, readable: DataFrame, time: str = "year", location: str = "city", country: str | None = None, seed: int = 0, coordinates: DataFrame | None = None) -> DataFrame:
    """The answer to one request: a random encounter, with lat and lon of both sides from ``coordinates`` (country, region, city, lat, lon).

    A country must be one of ``list_countries``, else ValueError; no row says that nobody met.
    """
    check_granularity(time, location)
    if country is not None and list_countries(points).filter(F.col("country") == country.strip().lower()).isEmpty():
        raise ValueError(f"unknown country {country!r}")
    from .sampling import random_encounter  # which draws with this module's predicates

    found = random_encounter(points, readable, time, location, country, seed)
    if coordinates is None:
        return found
    for s in "ab":
        at = {c: place_part(c, s) for c in ("country", "region", "city")}
        side = coordinates.select(*[F.col(c).alias(f"_{c}") for c in at], F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
        same = reduce(lambda p, q: p & q, [v.eqNullSafe(F.col(f"_{c}")) for c, v in at.items()])
        found = found.join(side, same, "left").drop(*[f"_{c}" for c in at])
    return found


def place_part(column: str, side: str) -> Column:
    """Country, region or city by which a side is put on a map: nothing of a fictional place, a journey's destination."""
    kind = F.col(f"location_type_{side}")
    end = F.lit(None).cast("string") if column == "region" else F.col(f"transit_to_{column}_{side}")
    return F.when(kind == "transit", end).when(kind != "fictional", F.col(f"{column}_{side}"))


def list_countries(points: DataFrame) -> DataFrame:
    """Countries that points of at least two books name; continents are none. No join is needed for that."""
    known = points.filter(F.col("country").isNotNull() & ~F.col("country").isin(*CONTINENTS))
    return known.groupBy("country").agg(F.countDistinct("book_id").alias("n")).filter("n >= 2").select("country").orderBy("country")


#: Shares of the units, by first year, among which the first rows are looked for before all are.
HORIZONS = (1 / 64, 1 / 8)


def overlap_years(points: DataFrame, readable: DataFrame, location: str = "city", limit: int | None = 20) -> DataFrame:
    """Distinct characters, place and common years of pairs in the same year; first years first.

    Names are attached to the points, and what is alike is joined once; for all rows see ``_all_years``. With a ``limit`` not all pairs are listed: common
    years begin when the later of two begins, so among those that begin by some year the first rows are whole, and if they
    are enough, no others are paired; see ``_first_rows``.
    """
    levels = LOCATION_LEVELS[: LOCATION_LEVELS.index(location) + 1]
    named = points.select("event_id", "book_id", "y_start", "y_end", *levels).join(readable.select("event_id", "character_name"), "event_id")
    units = named.drop("event_id").filter(F.col(location).isNotNull() & F.col("y_start").isNotNull() & F.col("y_end").isNotNull())
    if limit is None:
        return _all_years(units.filter("book_id IS NOT NULL").distinct(), location)
    # Two groups of alike points have one place and one pair of common years, so of each only the first names can be in the first rows.
    alike = ["book_id", "y_start", "y_end", *levels]
    few = units.withColumn("_n", F.dense_rank().over(Window.partitionBy(*alike).orderBy("character_name"))).filter(F.col("_n") <= limit)
    groups = checkpointed(few.groupBy(*alike).agg(F.sort_array(F.collect_set(F.struct("character_name"))).alias("names")))
    for year in groups.approxQuantile("y_start", list(HORIZONS), 0.001):
        # Ranges that end before they begin have no common years, so they come last.
        found = checkpointed(_first_rows(groups.filter(F.col("y_start") <= year), location, limit, F.col("overlap_start").isNotNull()))
        if found.count() == limit:
            return found.orderBy(*_by_years())
    return _first_rows(groups, location, limit, F.lit(True))


#: Units, and rows for the common years they can have, up to which a name's pairs in a place are given without being made distinct.
UNITS, SPANS = 32, 512


def _all_years(units: DataFrame, location: str) -> DataFrame:
    """All distinct rows of ``overlap_years``, of distinct units.

    A unit has a row for each pair of first and last common years (a span) it can have. In a place and span, a name falls
    into one class by what it knows there, less what a vaguer unit says as well; classes that meet give all pairs of their
    names, each once, so that no pairs are shuffled. Only pairs with names of too many units, or of ranges that are very long
    or end before they begin, are listed and made distinct.
    """
    years = F.col("y_end") - F.col("y_start") + 1
    sides = units.groupBy(location, "character_name").agg(F.count("*").alias("n"), F.sum(years.cast("double") * (years + 1) / 2).alias("spans"), F.min(years).alias("least"))
    apart = checkpointed(sides.filter((F.col("n") > UNITS) | (F.col("spans") > SPANS) | (F.col("least") < 1)).select(location, "character_name"))
    units = checkpointed(units)
    same = (F.col(f"u.{location}") == F.col(f"x.{location}")) & F.col("u.character_name").eqNullSafe(F.col("x.character_name"))
    some, others = (units.alias("u").join(apart.alias("x"), same, how) for how in ("left_anti", "left_semi"))
    found = _years_of_classes(some, location)
    if apart.isEmpty():
        return found
    names = [F.col(f"{s}.character_name").alias(f"character_{s}") for s in "ab"]
    listed = [_joined(a, "year", location, b).select(*names, *_common(location)) for a, b in ((others, units), (some, others))]
    return found.union(listed[0].union(listed[1]).distinct())


def _years_of_classes(units: DataFrame, location: str) -> DataFrame:
    """``_all_years`` of names with few units, by classes."""
    wild, span = list(LOCATION_LEVELS[: LOCATION_LEVELS.index(location)]), [location, "overlap_start", "overlap_end"]
    spans = units.withColumn("overlap_start", F.explode(F.sequence("y_start", "y_end"))).withColumn("overlap_end", F.explode(F.sequence("overlap_start", "y_end")))
    unit = F.struct("book_id", (F.col("y_start") == F.col("overlap_start")).alias("starts"), (F.col("y_end") == F.col("overlap_end")).alias("ends"), *wild)
    # Dealt once: names, classes and their pairs are formed where the units of a place and span lie.
    said = _dealt(spans.select(*span, "character_name", unit.alias("unit")), span).groupBy(*span, "character_name").agg(F.sort_array(F.collect_set("unit")).alias("all"))
    also = lambda u, v: reduce(lambda p, q: p & q, [u["book_id"] == v["book_id"], *[v[c] | ~u[c] for c in ("starts", "ends")], *[v[c].isNull() | v[c].eqNullSafe(u[c]) for c in wild]])
    vaguest = F.filter("all", lambda u: ~F.exists("all", lambda v: also(u, v) & (u != v)))
    said = said.withColumn("all", F.when(F.size("all") == 1, F.col("all")).otherwise(vaguest))
    number = F.row_number().over(Window.partitionBy(*span, "all").orderBy("character_name"))
    classes = said.withColumn("_list", F.floor((number - 1) / F.lit(LIST))).groupBy(*span, "all", "_list").agg(F.collect_list(F.struct("character_name")).alias("names"))
    rows = classes.select(*span, "all", "names", F.posexplode("all").alias("k", "unit")).select(*span, "all", "names", "k", "unit.*")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in span] + [alike(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in wild]
    # Coalesced, so that no filter of nulls is put on one side only: one deal serves both.
    cond = reduce(lambda p, q: p & q, same) & F.coalesce(F.col("a.book_id") < F.col("b.book_id"), F.lit(False)) & (F.col("a.starts") | F.col("b.starts")) & (F.col("a.ends") | F.col("b.ends"))
    meets = lambda u, v: reduce(lambda p, q: p & q, [u["book_id"] < v["book_id"], *[u[c] | v[c] for c in ("starts", "ends")], *[alike(u[c], v[c]) for c in wild]])
    # Of classes that meet several times, the least pair of units counts.
    pairs_of = F.flatten(F.transform("a.all", lambda u, i: F.transform(F.filter(F.transform("b.all", lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda y: meets(u, y["v"])), lambda y: F.struct(i.alias("i"), y["j"].alias("j")))))
    least = F.array_min(pairs_of) == F.struct(F.col("a.k").alias("i"), F.col("b.k").alias("j"))
    # Last in the join's condition; a filter after the join would be looked at first.
    once = (F.size("a.all") == 1) & (F.size("b.all") == 1) | least
    met = rows.alias("a").join(rows.alias("b"), cond & once).select(*[F.col(f"{s}.names").alias(f"names_{s}") for s in "ab"], *[F.col(f"a.{c}").alias(c) for c in span])
    for s in "ab":
        met = met.select("*", F.inline(f"names_{s}").alias(f"character_{s}")).drop(f"names_{s}")
    return met.select("character_a", "character_b", F.col(location).alias("place"), "overlap_start", "overlap_end")


def _common(location: str) -> list[Column]:
    """place, overlap_start and overlap_end of a pair."""
    start, end = F.greatest("a.y_start", "b.y_start"), F.least("a.y_end", "b.y_end")
    return [F.col(f"a.{location}").alias("place"), F.when(start <= end, start).alias("overlap_start"), F.when(start <= end, end).alias("overlap_end")]


def _by_years() -> list[Column | str]:
    """The order of rows: first years first, pairs without common years last."""
    return [F.asc_nulls_last("overlap_start"), F.asc_nulls_last("overlap_end"), "character_a", "character_b", "place"]


def _first_rows(groups: DataFrame, location: str, limit: int, wanted: Column) -> DataFrame:
    """The first rows of pairs of ``groups`` (names: their first ones).

    Each pair of groups first gives its first row only. If there are ``limit`` of these, no pair of groups that begins after
    the last of them has any of the first rows; all names are paired of the others only.
    """
    names = lambda s, n: F.col(f"{s}.names")[n]["character_name"]
    met = _joined(groups, "year", location).select(*[F.col(f"{s}.names").alias(f"names_{s}") for s in "ab"], *[names(s, 0).alias(f"character_{s}") for s in "ab"], *_common(location)).filter(wanted)
    row = F.struct(F.col("overlap_start").isNull().alias("p"), "overlap_start", F.col("overlap_end").isNull().alias("q"), "overlap_end", "character_a", "character_b", "place")
    heads = met.select("character_a", "character_b", "place", "overlap_start", "overlap_end").distinct().orderBy(*_by_years()).limit(limit)
    last = checkpointed(heads.agg(F.count("*").alias("_n"), F.max(row).alias("_last")))
    near = met.join(F.broadcast(last), (F.col("_n") < limit) | (row <= F.col("_last"))).drop("character_a", "character_b", "_n", "_last")
    for s in "ab":
        near = near.withColumn(f"names_{s}", F.explode(f"names_{s}"))
    rows = near.select(*[F.col(f"names_{s}.character_name").alias(f"character_{s}") for s in "ab"], "place", "overlap_start", "overlap_end").distinct()
    return rows.orderBy(*_by_years()).limit(limit)


def same_book_check(points: DataFrame, books: DataFrame, time: str = "year", location: str = "city") -> DataFrame:
    """total pairs, and those of which both books have one title (expected none): all pairs less those of different titles, both counted."""
    titled = points.join(books.select("book_id", F.coalesce("title", F.concat(F.lit("\0"), F.col("book_id").cast("string"))).alias("_title")), "book_id")
    total = pair_count(titled.drop("_title"), time, location).withColumn("apart", F.lit(0).cast("long"))
    apart = pair_count(titled.drop("book_id").withColumnRenamed("_title", "book_id"), time, location).select(F.lit(0).cast("long").alias("n"), F.col("n").alias("apart"))
    return total.union(apart).agg(F.sum("n").alias("total"), F.sum(F.col("n") - F.col("apart")).alias("same_book"))
