"""Place refinement event by event: later events see the places that earlier ones got.

What an event gets depends on earlier events only, so rounds over all events at once end in the one answer: a round looks
up every event's best place among the present places of earlier events and the given ones of later events, and the last
round is the one that changes nothing. There are as many rounds as replacements that build on one another.

No pairs of events are formed. A place is offered under each of the vaguer places that it would refine, and a date for each
set of its parts that the other side may know, so agreement is an equality of keys; a range of years meets a year in one
of the blocks (of lengths 1, 2, 4, ...) that make up the range, of which each year lies in one of each length. Inside a key the best
earlier offer is a running maximum in the order of events, which Spark sorts and spills; rows carry numbers, not texts.
Of a character only events that a deeper place of it could refine ask, and offers are made only for the known levels and
classes of dates of those that ask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import HIERARCHY, PLACE, TIME
from ..sources.session import checkpointed

KEY = ("book_id", "character_id")
PARTS = ("time_year", "time_month", "time_day")
#: Bit of a date that is a range of years.
RANGED = 1 << len(PARTS)


def depth(get=F.col) -> Column:
    """Number of the most specific known level, -1 if there is none."""
    return F.greatest(F.lit(-1), *[F.when(get(c).isNotNull(), n) for n, c in enumerate(HIERARCHY)])


def filled(get=F.col) -> Column:
    """How many levels are known."""
    return reduce(lambda p, q: p + q, [get(c).isNotNull().cast("int") for c in HIERARCHY])


def vaguer(get=F.col) -> Column:
    """The levels of all places that this one would refine: some of its own, its most specific not among them."""
    keeps = [[n for n in range(len(HIERARCHY)) if mask >> n & 1] for mask in range(1 << len(HIERARCHY))]
    some = lambda k: F.struct(*[(get(c) if n in k else F.lit(None).cast("string")).alias(c) for n, c in enumerate(HIERARCHY)])
    return F.array_distinct(F.array_compact(F.array(*[F.when(depth(get) > max(k, default=-1), some(k)) for k in keeps])))


def _date_class() -> Column:
    """Which parts of the date are known, and whether it is a range."""
    ranged = F.col("time_year_range_start").isNotNull() | F.col("time_year_range_end").isNotNull()
    return sum((F.when(F.col(c).isNotNull(), 1 << n).otherwise(0) for n, c in enumerate(PARTS)), F.when(ranged, RANGED).otherwise(0))


def _blocks(first: int, bits: int) -> tuple[Column, Column]:
    """Blocks that make up the range of years, and all blocks in which the year lies; years count from ``first``."""
    span = (1 << bits) - 1
    start = F.coalesce(F.col("time_year_range_start").cast("long") - first, F.lit(0))
    end = F.coalesce(F.col("time_year_range_end").cast("long") - first, F.lit(span))
    year = F.col("time_year").cast("long") - first
    number = lambda level, n: n + F.lit(1 << (bits - level)).cast("long")
    whole, around = [], []
    for level in range(bits + 1):
        low, high = F.shiftright(start + ((1 << level) - 1), level), F.shiftright(end + 1, level) - 1
        inside = low <= high
        # A block counts if the one of twice its length around it is not in the range too.
        whole += [F.when(inside & (low % 2 == 1), number(level, low)), F.when(inside & (high % 2 == 0), number(level, high))]
        around.append(number(level, F.shiftright(year, level)))
    return F.array_distinct(F.array_compact(F.array(*whole))), F.array(*around)


def levels(get=F.col) -> Column:
    """Which levels are known, as a number."""
    return sum((F.when(get(c).isNotNull(), 1 << n).otherwise(0) for n, c in enumerate(HIERARCHY)), F.lit(0))


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _in_use(fixed: DataFrame) -> DataFrame:
    """``fixed`` with what its character has: _asks (a deeper place exists), and as bits the known levels (_wanted) and date classes (_asking) of those that ask, and all date classes (_offering)."""
    w, given = Window.partitionBy(*KEY), lambda c: F.col(f"_given.{c}")
    rows = fixed.withColumn("_asks", depth(given) < F.max(depth(given)).over(w))
    bits = lambda n, some: F.coalesce(F.bit_or(F.when(some, bit(n))).over(w), F.lit(0).cast("long"))
    return rows.withColumns({"_wanted": bits(levels(given), F.col("_asks")), "_asking": bits(F.col("_class"), F.col("_asks")), "_offering": bits(F.col("_class"), F.lit(True))})


def _dated(rows: DataFrame, asking: bool, classes: list[int], first: int, bits: int) -> DataFrame:
    """``rows`` for each class of dates that the other side of its character has, under keys that are equal where dates agree."""
    own, other, nowhere = F.col("_class"), F.col("_other"), F.array(F.lit(None).cast("long"))
    used = F.col("_offering" if asking else "_asking")
    rows = rows.withColumn("_other", F.explode(F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: used.bitwiseAND(bit(c)) != 0)))
    ranged, meets_range = own >= RANGED, other >= RANGED
    whole, around = _blocks(first, bits)
    blocks = F.when(ranged & ~meets_range & (other % 2 == 1), whole).when(~ranged & meets_range & (own % 2 == 1), around).otherwise(nowhere)
    both = own.bitwiseAND(other)
    shared = [F.when(both.bitwiseAND(F.lit(1 << n)) != 0, F.col(c)).alias(f"_k{n}") for n, c in enumerate(PARTS)]
    pair = F.when(F.lit(asking), own * 2 * RANGED + other).otherwise(other * 2 * RANGED + own).alias("_pair")
    return rows.select(*KEY, "_at", "_as", "_rank", pair, *shared, F.explode(blocks).alias("_block"))


def _best(asked: DataFrame, offers: DataFrame, sign: int) -> DataFrame:
    """(key, _at, _rank): of each event the best offer of the events before it (``sign`` 1) or after it (-1)."""
    same = [c for c in asked.columns if c not in ("_at", "_rank")]
    rows = asked.withColumn("_asks", F.lit(True)).unionByName(offers.withColumn("_asks", F.lit(False)))
    before = Window.partitionBy(*same).orderBy("_pos").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_pos", F.col("_at") * sign).withColumn("_rank", F.max("_rank").over(before))
    return rows.filter("_asks AND _rank IS NOT NULL").groupBy(*KEY, "_at").agg(F.max("_rank").alias("_rank"))


def refine_in_order(events: DataFrame) -> DataFrame:
    """Each event's place replaced, event by event, by the most specific one that it nests in at a compatible time.

    ``events``: book_id, character_id, ordinal, the columns of TIME and PLACE; others travel along. Of equally specific
    places the first in order counts; events of one ordinal are ordered by their dates and places. Journeys stay as they
    are and refine nothing; null ids are ids of their own, a null type of place is no journey; an empty table stays empty.
    """
    names, ties = events.columns, [F.col(c) for c in (*TIME, *PLACE)]
    # Columns that only travel along do so under plain names.
    events = events.toDF(*[c if c in (*KEY, *TIME, *PLACE, "ordinal") else f"x{n}" for n, c in enumerate(names)])
    rows = checkpointed(events.withColumn("_at", F.row_number().over(Window.partitionBy(*KEY).orderBy("ordinal", *ties)).cast("long")))
    fixed = rows.filter("coalesce(location_type, '') <> 'transit'").withColumn("_class", _date_class())
    fixed = checkpointed(_in_use(fixed.select(*KEY, "_at", *TIME, "_class", F.struct(*PLACE).alias("_given"))))
    classes = sorted(r[0] for r in fixed.select("_class").distinct().collect())
    if not classes:
        return rows.drop("_at").toDF(*names)
    years = ("time_year", "time_year_range_start", "time_year_range_end")
    lowest, highest = fixed.agg(F.least(*[F.min(c) for c in years]), F.greatest(*[F.max(c) for c in years])).first()
    first = lowest or 0
    dated = (classes, first, max(1, ((highest or 0) - first).bit_length()))

    given = lambda c: F.col(f"_given.{c}")
    none = F.lit(None).cast("struct<d:int,f:int,o:bigint>").alias("_rank")
    asked = fixed.filter("_asks").select("*", F.struct(*[given(c).alias(c) for c in HIERARCHY]).alias("_as"), none)
    asked = checkpointed(_dated(asked, True, *dated))

    def offers(places: DataFrame) -> DataFrame:
        get = lambda c: F.col(f"_place.{c}")
        rank = F.struct(depth(get).alias("d"), filled(get).alias("f"), (-F.col("_at")).alias("o")).alias("_rank")
        asked_for = F.filter(vaguer(get), lambda p: F.col("_wanted").bitwiseAND(bit(levels(lambda c: p[c]))) != 0)
        return _dated(places.filter(depth(get) >= 0).select("*", rank, F.explode(asked_for).alias("_as")), False, *dated)

    present = fixed.withColumn("_place", F.col("_given"))
    later = checkpointed(_best(asked, offers(present), -1))
    same = lambda a, b, *cols: reduce(lambda p, q: p & q, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
    changed = 1
    while changed:
        found = later.unionByName(_best(asked, offers(present), 1)).groupBy(*KEY, "_at").agg(F.max("_rank").alias("_rank"))
        found = found.select(*KEY, "_at", (-F.col("_rank.o")).alias("_from"))
        source = F.when(F.col("f._from") < F.col("f._at"), F.col("s._place")).otherwise(F.col("s._given"))
        taken = found.alias("f").join(present.alias("s"), same("f", "s", *KEY) & (F.col("f._from") == F.col("s._at")))
        taken = taken.select(*[F.col(f"f.{c}") for c in (*KEY, "_at")], source.alias("_new"))
        after = present.alias("p").join(taken.alias("t"), same("p", "t", *KEY, "_at"), "left")
        after = checkpointed(after.select("p.*", F.coalesce("t._new", "p._given").alias("_next")))
        changed = after.filter(~F.col("_next").eqNullSafe(F.col("_place"))).count()
        present = after.drop("_place").withColumnRenamed("_next", "_place")
    out = [F.when(F.col("m._place").isNotNull(), F.col(f"m._place.{c}")).otherwise(F.col(f"e.{c}")).alias(c) if c in PLACE else F.col(f"e.{c}") for c in events.columns]
    return rows.alias("e").join(present.alias("m"), same("e", "m", *KEY, "_at"), "left").select(*out).toDF(*names)
