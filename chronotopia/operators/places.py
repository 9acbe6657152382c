"""Places: refinement, identity, country names and gazetteer look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import ADDRESS_TYPES, COUNTRY_ALIASES, HIERARCHY, IMPORTANCE_MARGIN, PLACE, TIME, TRANSIT_FIELDS
from .refinement import bit, depth, filled, levels, refine_in_order, vaguer


def deepest_index(prefix: str = "") -> Column:
    """Number of the most specific known level, -1 if there is none."""
    return depth(lambda c: F.col(prefix + c))


def deepest_level(prefix: str = "") -> tuple[Column, Column]:
    """Name and value of the most specific known level."""
    down = list(reversed(HIERARCHY))
    return F.coalesce(*[F.when(F.col(prefix + c).isNotNull(), c) for c in down]), F.coalesce(*[F.col(prefix + c) for c in down])


def nests_inside(a: str = "a", b: str = "b") -> Column:
    """Place a says the same as b, only less; journeys nest nowhere."""
    x, y = a + ".", b + "."
    same = reduce(lambda p, q: p & q, [F.col(x + c).isNull() | F.col(x + c).eqNullSafe(F.col(y + c)) for c in HIERARCHY])
    here = (F.col(x + "location_type") != "transit") & (F.col(y + "location_type") != "transit")
    return here & same & (deepest_index(y) > deepest_index(x))


def time_compatible(a: str = "a", b: str = "b") -> Column:
    """Known parts agree; a range on one side only holds the other's year. Two ranges always agree."""
    col = lambda s, c: F.col(f"{s}.{c}")
    conds = [F.coalesce(col(a, c) == col(b, c), F.lit(True)) for c in ("time_year", "time_month", "time_day")]
    ranged = lambda s: col(s, "time_year_range_start").isNotNull() | col(s, "time_year_range_end").isNotNull()
    for p, q in ((a, b), (b, a)):
        year = col(q, "time_year")
        outside = F.coalesce(year < col(p, "time_year_range_start"), F.lit(False)) | F.coalesce(year > col(p, "time_year_range_end"), F.lit(False))
        conds.append(~(ranged(p) & ~ranged(q) & outside))
    return reduce(lambda p, q: p & q, conds)


def refine_locations(events: DataFrame, mode: str = "snapshot") -> DataFrame:
    """Each event's place replaced by the most specific one that it nests in, of the same character and a compatible time.

    ``events``: book_id, character_id, ordinal, the columns of TIME and PLACE. Of equally specific places the first in
    order counts. ``snapshot`` compares with the places as given; ``sequential`` lets later events see earlier
    replacements, event by event, see ``refinement``.
    """
    if mode == "sequential":
        return refine_in_order(events)
    if mode != "snapshot":
        raise ValueError(f"unknown mode {mode!r}")
    key = ["book_id", "character_id"]
    sign = [*key, *HIERARCHY, *TIME]
    # Deeper places rank first, then those with more levels, then earlier ones, in one number.
    rank = (depth() * 8 + filled()).cast("decimal(20,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") - F.coalesce(F.col("ordinal").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    fixed = events.filter("location_type <> 'transit'").withColumn("_rank", rank.cast("decimal(38,0)"))
    # Only places that a deeper one of their character could refine ask, and only for the levels that such places know are offers made.
    units = fixed.groupBy(*sign).agg(F.max("_rank").alias("_rank"))
    tops = units.groupBy(*key).agg(F.max(depth()).alias("_top"), F.max("_rank").alias("_best")).filter("_best IS NOT NULL").drop("_best")
    asked = units.join(tops, key).filter(depth() < F.col("_top")).select(*sign)
    wanted = asked.groupBy(*key).agg(F.bit_or(bit(levels())).alias("_wanted"))
    # Every place is offered under each of the vaguer places that it would refine, of which it keeps only some levels: so
    # nesting is an equality. Of equal times only the most specific place of each is offered, as its rank.
    asked_for = F.filter(vaguer(), lambda p: F.col("_wanted").bitwiseAND(bit(levels(lambda c: p[c]))) != 0)
    offers = units.join(wanted, key).filter(depth() >= 0).select(*key, *TIME, "_rank", F.explode(asked_for).alias("_as"))
    offers = offers.select(*key, *TIME, "_rank", "_as.*").groupBy(*sign).agg(F.max("_rank").alias("_rank"))
    same = lambda a, b, *cols: reduce(lambda p, q: p & q, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
    cond = reduce(lambda p, q: p & q, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key]) & same("a", "b", *HIERARCHY)
    best = asked.alias("a").join(offers.alias("b"), cond & time_compatible()).groupBy(*[F.col(f"a.{c}").alias(c) for c in sign]).agg(F.max("b._rank").alias("_rank"))
    places = fixed.select(*key, "_rank", F.struct(*PLACE).alias("best"))
    best = best.join(places, [*key, "_rank"]).dropDuplicates(sign).drop("_rank")
    met = same("e", "m", *sign) & (F.col("e.location_type") != "transit")
    out = [F.when(F.col("m.best").isNotNull(), F.col(f"m.best.{c}")).otherwise(F.col(f"e.{c}")).alias(c) if c in PLACE else F.col(f"e.`{c}`") for c in events.columns]
    return events.alias("e").join(best.alias("m"), met, "left").select(*out)


def location_identity() -> list[Column]:
    """What makes two events' places one: type, levels (not of a journey), ends and means; source and proximity do not."""
    levels = [F.when(F.col("location_type") != "transit", F.col(c)).alias(f"id_{c}") for c in HIERARCHY]
    return [F.col("location_type").alias("id_location_type"), *levels, *[F.col(c).alias(f"id_{c}") for c in (*TRANSIT_FIELDS, "transport_mode", "transport_detail")]]


def finalize_locations(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with location_id, locations): loc_1.. of each book by first appearance; the first event's values count.

    A journey without a named end is no journey: its type becomes ambiguous; a journey keeps no levels.
    """
    keyed = events.withColumn("_id", F.struct(*location_identity()))
    first = keyed.groupBy("book_id", "_id").agg(F.min("ordinal").alias("_first"), F.min_by(F.struct(*PLACE), F.col("ordinal")).alias("p"))
    w = Window.partitionBy("book_id").orderBy("_first")
    found = first.withColumn("location_id", F.concat(F.lit("loc_"), F.row_number().over(w).cast("string")))
    named = reduce(lambda p, q: p | q, [F.coalesce(F.col(f"p.{c}") != "", F.lit(False)) for c in TRANSIT_FIELDS])
    journey = F.coalesce(F.col("p.location_type") == "transit", F.lit(False)) & named
    kind = F.when(journey, "transit").when(F.col("p.location_type") == "transit", "ambiguous").otherwise(F.col("p.location_type"))
    locations = found.select(
        "book_id", "location_id", kind.alias("location_type"), *[F.when(~journey, F.col(f"p.{c}")).alias(c) for c in HIERARCHY], F.col("p.proximity").alias("proximity"),
        *[F.when(journey, F.col(f"p.{c}")).alias(c) for c in (*TRANSIT_FIELDS, "transport_mode", "transport_detail")], F.col("p.source").alias("source"),
    )
    ids = found.select("book_id", "_id", "location_id")
    cond = (F.col("e.book_id") == F.col("f.book_id")) & F.col("e._id").eqNullSafe(F.col("f._id"))
    rest = [F.col(f"e.{c}") for c in events.columns if c not in PLACE]
    return keyed.alias("e").join(ids.alias("f"), cond).select(*rest, F.col("f.location_id").alias("location_id")), locations


def transit_shape_violations(locations: DataFrame) -> DataFrame:
    """Journeys without an end or with a level, and other places with anything of a journey."""
    some = lambda cols: F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    journey = F.col("location_type") == "transit"
    bad = (journey & (~some(TRANSIT_FIELDS) | some(HIERARCHY))) | (~journey & some((*TRANSIT_FIELDS, "transport_mode", "transport_detail")))
    return locations.filter(bad)


def normalize_country(locations: DataFrame, force: bool = False) -> DataFrame:
    """Real places' country in its English name; country_normalized tells what was looked at, country_changed what changed."""
    scan = (F.col("location_type") == "real") & F.col("country").isNotNull() & (F.lit(force) | ~F.col("country_normalized"))
    names = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES for x in pair])
    new = F.coalesce(F.try_element_at(names, F.lower(F.trim("country"))), F.col("country"))
    out = locations.withColumn("_new", F.when(scan, new).otherwise(F.col("country"))).withColumn("country_changed", F.coalesce(F.col("_new") != F.col("country"), F.lit(False)))
    return out.withColumn("country", F.col("_new")).withColumn("country_normalized", F.col("country_normalized") | F.coalesce(scan, F.lit(False))).drop("_new")


def geo_same_place(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Candidates (rank) that are other places: the first of each name, then of each (city, country) that is known."""
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter("_n = 1").drop("_n")
    named = first(candidates, *key, "display_name")
    known = F.coalesce((F.col("place_city") != "") & (F.col("place_country") != ""), F.lit(False))
    # A candidate whose place is not known stands alone.
    return first(named.withColumn("_alone", F.when(~known, F.col("rank"))), *key, "_alone", F.when(known, F.struct("place_city", "place_country"))).drop("_alone")


def geo_accept(candidates: DataFrame, key: list[str], level: str = "level") -> DataFrame:
    """The first candidate of each look-up, if it is clearly ahead of the next and of a kind that suits the level."""
    w = Window.partitionBy(*key).orderBy("rank")
    rows = geo_same_place(candidates, key).withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("importance").over(w))
    clear = F.col("_next").isNull() | (F.coalesce("importance", F.lit(0.0)) - F.col("_next") >= IMPORTANCE_MARGIN)
    kinds = F.create_map(*[x for k, v in ADDRESS_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.try_element_at(kinds, F.col(level))
    suits = allowed.isNull() | F.coalesce(F.array_contains(allowed, F.col("addresstype")), F.lit(False))
    return rows.filter((F.col("_n") == 1) & clear & suits).drop("_n", "_next")


def geo_backfill(locations: DataFrame, gazetteer: DataFrame, overwrite: bool = True) -> DataFrame:
    """Real places' broader levels from the gazetteer (level, value, rank, ...), and geocode_status.

    ``overwrite`` replaces levels that were known too; without it only unknown ones are filled.
    """
    level, value = deepest_level()
    rows = locations.drop("geocode_status").withColumn("_level", level).withColumn("_value", value).withColumn("_at", deepest_index())
    keys = rows.filter("location_type = 'real' AND _level IS NOT NULL").select(F.col("_level").alias("level"), F.col("_value").alias("value")).distinct()
    found = geo_accept(gazetteer.join(keys, ["level", "value"]), ["level", "value"])
    fills = {"country": "place_country", "region": "place_region", "city": "place_city"}
    found = found.select(F.col("level").alias("_level"), F.col("value").alias("_value"), *[F.nullif(F.col(v), F.lit("")).alias(f"_{k}") for k, v in fills.items()])
    rows = rows.join(found, ["_level", "_value"], "left")
    own = {c: F.when((F.col("location_type") == "real") & (F.col("_at") > n), F.col(f"_{c}")) for n, c in enumerate(HIERARCHY) if c in fills}
    status = F.when((F.col("location_type") != "real") | F.col("_level").isNull(), "skipped").when(F.coalesce(*own.values()).isNotNull(), "resolved").otherwise("unresolved")
    put = {c: F.coalesce(v, F.col(c)) if overwrite else F.coalesce(F.col(c), v) for c, v in own.items()}
    out = [put[c].alias(c) if c in put else F.col(c) for c in locations.columns if c != "geocode_status"]
    return rows.select(*out, status.alias("geocode_status"))


def regeocode(locations: DataFrame, gazetteer: DataFrame, force: bool = False) -> DataFrame:
    """Real places that are not resolved (or all, by ``force``) looked up again; all others as they are."""
    again = (F.col("location_type") == "real") & (F.lit(force) | ~F.col("geocode_status").eqNullSafe("resolved"))
    new = geo_backfill(locations.filter(again), gazetteer)
    # A place that is skipped now keeps its status.
    return locations.filter(~again).unionByName(new.select(*locations.columns))


def geocode_one(places: DataFrame, answers: DataFrame) -> DataFrame:
    """Latitude and longitude of (country, region, city) from the answers to such look-ups; null where none is sure."""
    key = ["country", "region", "city"]
    level = F.when(F.coalesce(F.col("city"), F.lit("")) != "", "city").when(F.coalesce(F.col("region"), F.lit("")) != "", "region").otherwise("country")
    found = geo_accept(answers.withColumn("level", level), key)
    lat, lon = (F.expr(f"try_cast({c} AS double)") for c in ("lat", "lon"))
    found = found.select(*key, lat.alias("_lat"), lon.alias("_lon"))
    cond = reduce(lambda p, q: p & q, [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key])
    both = F.col("f._lat").isNotNull() & F.col("f._lon").isNotNull()
    return places.alias("p").join(found.alias("f"), cond, "left").select("p.*", F.when(both, F.col("f._lat")).alias("lat"), F.when(both, F.col("f._lon")).alias("lon"))
