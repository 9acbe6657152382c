"""Small fixtures for the rules that data from the star schema don't reach."""

import datetime
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chronotopia.functions.display import readable_location, readable_time
from chronotopia.functions.vocabulary import LOCATION_GRANULARITIES, TIME_GRANULARITIES
from chronotopia.operators import cleanup, encounters, fold, people, places, points, ranking, sampling, text
from chronotopia.sources import catalog, models, store
from chronotopia.streaming.points import append_points

POINT = "event_id long, book_id string, character_id long, y_start int, y_end int, time_month int, time_day int, location_id long, point_role string, country string, region string, city string, neighborhood string"


def pts(spark, *rows):
    """Points from (book, start, end, month, day, country, region, city, neighborhood)."""
    return spark.createDataFrame([(i, r[0], i, *r[1:5], i, "place", *r[5:]) for i, r in enumerate(rows)], POINT)


def n(points, time, location, country=None):
    a = encounters.pair_count(points, time, location, country).first()["n"]
    assert a == encounters.pairs(points, time, location, country).count()
    return a


def test_null_month_agrees_with_any(spark):
    p = pts(spark, ("a", 1800, 1800, None, None, "x", None, "c", None), ("b", 1800, 1800, 5, 3, "x", None, "c", None), ("c", 1800, 1800, 6, 3, "x", None, "c", None))
    assert n(p, "month", "city") == 2 and n(p, "day", "city") == 2 and n(p, "year", "city") == 3


def test_centuries_and_decades_floor(spark):
    at = lambda book, y: (book, y, y, None, None, "x", None, None, None)
    p = pts(spark, at("a", 1799), at("b", 1800), at("c", 1899))
    assert n(p, "century", "country") == 1 and n(p, "year", "country") == 0
    assert n(pts(spark, at("a", -5), at("b", 5)), "decade", "country") == 0
    assert n(pts(spark, at("a", -5), at("b", -1)), "decade", "country") == 1


def test_half_open_range_matches_without_time_only(spark):
    p = pts(spark, ("a", 1800, None, None, None, "x", None, None, None), ("b", 1800, 1800, None, None, "x", None, None, None))
    assert n(p, "none", "country") == 1 and n(p, "none", "none") == 1
    assert all(n(p, t, loc) == 0 for t in ("century", "year", "day") for loc in ("country", "none"))


def test_coarser_level_must_agree_or_be_unknown(spark):
    y = (1800, 1800, None, None)
    p = pts(spark, ("a", *y, "x", None, "c", None), ("b", *y, "y", None, "c", None), ("c", *y, None, None, "c", None))
    assert n(p, "year", "city") == 2 and n(p, "year", "neighborhood") == 0


def test_long_and_inverted_ranges_pair_once(spark):
    rows = [("a", 1700, 1900), ("b", 1750, 1760), ("c", 1760, 1750), ("d", 1899, 2100), ("e", 1901, 1990)]
    p = pts(spark, *[(b, s, e, None, None, "x", None, None, None) for b, s, e in rows])
    want = sum(x[1] <= y[2] and y[1] <= x[2] for i, x in enumerate(rows) for y in rows[i + 1 :])
    assert n(p, "year", "none") == n(p, "year", "country") == want


def test_same_book_never_pairs_and_country_filter(spark):
    y = (1800, 1800, None, None)
    assert n(pts(spark, ("a", *y, "x", None, "c", None), ("a", *y, "x", None, "c", None)), "none", "none") == 0
    assert n(pts(spark, ("a", *y, "france", None, "c", None), ("b", *y, "france", None, "c", None)), "year", "city", " France ") == 1


@pytest.mark.parametrize("time,location", [("week", "city"), ("year", "street")])
def test_unknown_granularity(spark, time, location):
    with pytest.raises(ValueError):
        encounters.pairs(pts(spark, ("a", 1, 1, None, None, "x", None, None, None)), time, location)


def test_no_nested_loop_join(spark):
    """No listing of pairs but the one without any restriction plans a nested loop, and no count does."""
    p = pts(spark, ("a", 1800, 1800, None, None, "x", None, "c", None))
    for time in TIME_GRANULARITIES:
        for location in LOCATION_GRANULARITIES:
            for df in ([encounters.pairs(p, time, location)] if (time, location) != ("none", "none") else []) + [encounters.pair_count(p, time, location)]:
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_counts_are_as_listing_all_pairs(spark):
    """Random points with unknowns, half ranges, ranges that end before they begin, and points without a book."""
    rng = random.Random(3)
    some = lambda *x: rng.choice([None, *x])
    rows = []
    for _ in range(250):
        y = rng.randint(1795, 1812)
        z = y + rng.choice([0, 0, 0, 3, -2, -9])
        rows.append((rng.choice(["a", "b", "c", None]), some(y, y, y), some(z, z, z), some(1, 2), some(1, 2), some("x", "y"), some("r"), some("c", "d"), some("n")))
    p = pts(spark, *rows).cache()
    for time, location in (("none", "none"), ("year", "city"), ("year", "none"), ("decade", "region"), ("month", "country"), ("day", "neighborhood"), ("none", "city"), ("day", "none")):
        assert n(p, time, location) > 0
    assert n(p, "year", "city", " X ") > 0 and n(p, "year", "city", "q") == 0


def test_continents_are_no_countries(spark):
    y = (1800, 1800, None, None)
    p = pts(spark, ("a", *y, "europe", None, None, None), ("b", *y, "europe", None, None, None), ("a", *y, "italy", None, None, None), ("b", *y, "italy", None, None, None), ("a", *y, "spain", None, None, None))
    assert [r.country for r in encounters.list_countries(p).collect()] == ["italy"]


LOC = "location_id long, location_type string, country string, region string, city string, neighborhood string, street string, transit_from_country string, transit_from_city string, transit_to_country string, transit_to_city string, transport_mode string"


def test_journeys_have_points_for_known_ends(spark):
    rows = [(1, "transit", "leak", None, None, None, None, "F", None, "F", "T", "on_foot"), (2, "transit", None, None, None, None, None, None, None, None, "T", None), (3, "real", None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, LOC)
    got = sorted((r.location_id, r.point_role, r.country, r.city, r.region) for r in points.location_points(df).collect())
    assert got == [(1, "from", "F", None, None), (1, "to", "F", "T", None), (2, "to", None, "T", None), (3, "place", None, None, None)]
    said = [r.x for r in df.orderBy("location_id").select(readable_location().alias("x")).collect()]
    assert said == ["travelling from F to T by on foot", "travelling from an unknown place to T", "an unspecified location"]


def test_readable_time(spark):
    rows = [("day", 1872, 10, 2, None, None, "stated"), ("day", 1872, 10, None, None, None, "stated"), ("day", 1871, 2, 30, None, None, "stated"), ("month", 1872, 5, None, None, None, "stated"), ("year", 1872, None, None, None, None, "stated"),
            ("year_range", None, None, None, 1870, 1880, "book_estimated"), ("year_range", None, None, None, 1870, None, "stated"), (None, 1, 1, 1, 1, 1, "stated")]
    df = spark.createDataFrame(rows, "time_precision string, time_year int, time_month int, time_day int, time_year_range_start int, time_year_range_end int, time_source string").coalesce(1)
    assert [r.x for r in df.select(readable_time(False).alias("x")).collect()] == ["02 October 1872", None, None, "May 1872", "1872", "estimated 1870-1880", None, "an unknown time"]
    assert df.select(readable_time().alias("x")).first().x == "02 October   1872"


def test_support_counts_point_pairs(spark):
    locs = spark.createDataFrame([(1, "transit", None, None, None, None, None, "x", None, "x", None, None), (2, "real", "x", None, None, None, None, None, None, None, None, None)], LOC)
    ev = spark.createDataFrame([(1, "a", 1, 1, "year", 1800), (2, "b", 2, 2, "year", 1800), (3, "b", 2, 2, None, 1800)], "event_id long, book_id string, character_id long, location_id long, time_precision string, time_year int")
    ev = ev.selectExpr("*", *[f"cast(null as int) {c}" for c in ("time_month", "time_day", "time_year_range_start", "time_year_range_end")], "'stated' time_source", "cast(null as string) evidence_quote")
    p = points.event_match_points(ev, locs)
    assert p.count() == 3
    books = spark.createDataFrame([("a", "A"), ("b", "B")], "book_id string, title string")
    chars = spark.createDataFrame([("a", 1, "X"), ("b", 2, "Y")], "book_id string, character_id long, canonical_name string")
    r = points.event_readable(ev, books, chars, locs)
    for got in (encounters.encounters(p, r, "year", "country"), encounters.encounter_groups(encounters.pairs(p, "year", "country"), r, F.col("event_id_a"))):
        assert [(g.character_a, g.character_b, g.support_count) for g in got.collect()] == [("X", "Y", 2)]
    at = spark.createDataFrame([("x", None, None, 1.5, 2.5)], "country string, region string, city string, lat double, lon double")
    one = encounters.encounter(p, r, "year", "country", "X", coordinates=at).first()
    assert (one.character_a, one.lat_a, one.lon_b) == ("X", 1.5, 2.5)
    with pytest.raises(ValueError):
        encounters.encounter(p, r, "year", "country", "nowhere")
    assert sampling.random_encounter(p, r, "year", "country").count() == 1
    assert sampling.random_encounter(p, r, "year", "city").count() == 0


def test_headings():
    toc = "CHAPTER I\n\nCHAPTER II\n\nCHAPTER I\n\nbody one\n\nCHAPTER II\n\nbody two"
    assert [t for t, _ in text.chapters_of(toc)] == ["CHAPTER I", "CHAPTER II"]
    assert text.chapters_of(toc)[0][1].strip() == "body one"
    assert [h[3] for h in text.headings("CHAPTER\n\nIV\nx\nPart 2\ny")] == ["iv", "2"]
    assert [h[3] for h in text.headings("I. PLAYING PILGRIMS\r\nx\nII. A MERRY TIME\r\n")] == ["i", "ii"]
    assert [h[3] for h in text.headings("STORY OF THE DOOR\r\nx\nTHE LAST NIGHT\n")] == ["story of the door", "the last night"]
    assert len(text.headings("Chapter 1\n only")) == 1 and text.headings("no heading") == []
    found = text.headings("BOOK I\nCHAPTER I\nx\nCHAPTER II\ny")
    assert text.contents_length(found) == 1
    far = "CHAPTER I\n" + "x " * 400 + "\nCHAPTER II\n" + "y " * 400
    assert text.contents_length(text.headings(far + "\n" + far)) == 0


def test_chapters_and_paragraphs(spark):
    df = spark.createDataFrame([(1, "front\n\nCHAPTER I\n\na  b\n 　\nc\n\nCHAPTER II\n\n  \n\nCHAPTER III\nd"), (2, "only\n\ntext"), (3, ""), (4, None)], "book_id int, text string")
    got = [(r.book_id, r.chapter, r.title, r.paragraphs) for r in text.split_chapters(df).orderBy("book_id", "chapter").collect()]
    assert got == [(1, 1, "CHAPTER I", ["a b", "c"]), (1, 2, "CHAPTER III", ["d"]), (2, 1, None, ["only", "text"])]
    chapters = spark.range(1, 6).select(F.lit(1).alias("book_id"), F.col("id").alias("chapter"))
    assert text.chapter_sample(chapters, 50).count() == 2 and text.chapter_sample(chapters, 1).count() == 1
    with pytest.raises(ValueError):
        text.chapter_sample(chapters, 0)


def test_strip_boilerplate(spark):
    rows = ["x *** START OF THIS PROJECT GUTENBERG EBOOK\nY *** body *** end of the project gutenberg ebook z *** t", " plain ", "a *** START OF THE PROJECT GUTENBERG EBOOK B *** c"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(text.strip_boilerplate(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["body", "plain", "c"]


TIME = "time_year_range_start int, time_year_range_end int, time_year int, time_month int, time_day int"
EVENT = f"event_id long, book_id string, character_id long, ordinal int, {TIME}, location_type string, country string, region string, city string, neighborhood string, street string, proximity string, transit_from_country string, transit_from_city string, transit_to_country string, transit_to_city string, transport_mode string, transport_detail string, source string"


def ev(spark, *rows):
    """Events from dicts; ordinal is the place in the list."""
    names = [c.strip().split()[0] for c in EVENT.split(",")]
    base = {"book_id": "b", "character_id": 1, "location_type": "real"}
    return spark.createDataFrame([tuple((base | {"event_id": i, "ordinal": i} | r).get(c) for c in names) for i, r in enumerate(rows)], EVENT)


def cities(df):
    return [r.city or r.street or r.country for r in df.orderBy("ordinal").collect()]


def test_refinement_snapshot_and_sequential(spark):
    england, london = {"country": "England", "time_year": 1800}, {"country": "England", "city": "London"}
    row = {"country": "England", "city": "London", "street": "Saville Row", "time_year": 1801}
    one, two = ev(spark, england, london, row), ev(spark, london, england, row)
    streets = lambda df, mode: [r.street for r in places.refine_locations(df, mode).orderBy("ordinal").collect()]
    assert streets(one, "snapshot") == [None, "Saville Row", "Saville Row"] and streets(two, "snapshot") == ["Saville Row", None, "Saville Row"]
    assert streets(one, "sequential") == [None, "Saville Row", "Saville Row"] and streets(two, "sequential") == ["Saville Row", "Saville Row", "Saville Row"]


def test_two_ranges_are_compatible_and_ties_go_to_the_first(spark):
    a = {"country": "E", "time_year_range_start": 1, "time_year_range_end": 2}
    df = ev(spark, a, {"country": "E", "city": "X", "time_year_range_start": 8, "time_year_range_end": 9}, {"country": "E", "city": "Y"}, {"location_type": "transit", "country": "E"})
    assert cities(places.refine_locations(df)) == ["X", "X", "Y", "E"] == cities(places.refine_locations(df, "sequential"))


def test_location_identity(spark):
    df = ev(spark, {"country": "E", "proximity": "at", "source": "stated"}, {"country": "E", "proximity": "area", "source": "inferred"},
            {"location_type": "transit", "city": "L"}, {"location_type": "transit", "city": "M"}, {"location_type": "transit", "transit_from_city": ""}, {"location_type": "transit", "transit_to_city": "Z", "city": "leak"})
    events, locs = places.finalize_locations(df)
    assert [r.location_id for r in events.orderBy("ordinal").collect()] == ["loc_1", "loc_1", "loc_2", "loc_2", "loc_3", "loc_4"]
    got = {r.location_id: (r.location_type, r.city, r.proximity) for r in locs.collect()}
    assert got == {"loc_1": ("real", None, "at"), "loc_2": ("ambiguous", "L", None), "loc_3": ("ambiguous", None, None), "loc_4": ("transit", None, None)}
    assert places.transit_shape_violations(locs).isEmpty()


def test_completeness(spark):
    df = ev(spark, {"country": "E", "time_month": 5, "time_day": 1}, {"time_year": 1800}, {"location_type": "transit", "transit_to_city": "", "time_year": 1}, {"country": "E", "time_year_range_end": 3})
    df = df.withColumn("time_precision", F.lit("day")).withColumn("time_source", F.lit("stated")).withColumn("story_chronological_order", F.lit(7))
    est = lambda c: spark.createDataFrame([("b", 1850, 1860, c)], "book_id string, year_range_start int, year_range_end int, setting_confidence string")
    got = {r.event_id: r for r in cleanup.filter_complete_events(df, est("medium")).collect()}
    assert sorted(got) == [0, 2, 3] and (got[0].time_year_range_start, got[0].time_month, got[0].time_source, got[0].story_chronological_order) == (1850, None, "book_estimated", 7)
    assert sorted(r.event_id for r in cleanup.filter_complete_events(df, est("low")).collect()) == [2, 3]
    assert cleanup.filter_complete_events(df, est("high"), strict=True).filter("event_id = 0").first().story_chronological_order is None


def test_chains_cycles_and_merges(spark):
    m = lambda *r: spark.createDataFrame([("b", *x) for x in r], "book_id string, position int, canonical_id string, member_id string")
    chain = m((1, "B", "A"), (1, "B", "B"), (2, "C", "B"), (2, "C", "C"))
    r = people.redirect_map(chain)
    assert sorted((x.old_id, x.new_id) for x in r.collect()) == [("A", "C"), ("B", "C")]
    for bad in (m((1, "B", "A"), (2, "A", "B")), m((1, "B", "A"), (2, "C", "B"), (3, "A", "C"))):
        with pytest.raises(ValueError):
            people.redirect_map(bad)
    chars = spark.createDataFrame([("b", "A", "Ann", ["x"]), ("b", "B", "Bob", []), ("b", "C", "Cy", ["z"])], "book_id string, character_id string, canonical_name string, aliases array<string>")
    events = spark.createDataFrame([("b", "A"), ("b", "C")], "book_id string, character_id string")
    kept, moved = people.apply_merges(chars, events, r)
    assert [(k.character_id, k.aliases) for k in kept.collect()] == [("C", ["Ann", "Bob", "x", "z"])] and {e.character_id for e in moved.collect()} == {"C"}


def test_later_group_overwrites(spark):
    m = spark.createDataFrame([("b", 1, "X", "A"), ("b", 2, "Y", "A")], "book_id string, position int, canonical_id string, member_id string")
    assert [(x.old_id, x.new_id) for x in people.redirect_map(m).collect()] == [("A", "Y")]


def test_registry_first_declaration_wins(spark):
    declared = spark.createDataFrame([("b", 2, 0, 0, "x", "Late", [])], "book_id string, chapter int, kind int, ordinal int, id string, canonical_name string, aliases array<string>")
    used = spark.createDataFrame([("b", 1, 0, "x"), ("b", 2, 1, "x")], "book_id string, chapter int, ordinal int, character_id string")
    holes = fold.orphan_placeholders(declared, used)
    assert [r.canonical_name for r in fold.merge_registry(declared.unionByName(holes)).collect()] == ["Unknown (x)"]
    assert fold.filter_targets(used, used.limit(0).select("book_id", F.col("character_id").alias("id"))).isEmpty()


def test_malformed_answers(spark):
    rows = [("b", 1, '"abc"'), ("b", 2, '["p", {"id": "q", "canonical_name": "Q", "aliases": ["r"]}]'), ("b", 3, None), ("b", 4, "{}")]
    got = fold.normalize_new_characters(spark.createDataFrame(rows, "book_id string, chapter int, new_characters string"))
    assert sorted((r.chapter, r.id, r.canonical_name, tuple(r.aliases)) for r in got.collect()) == [(2, "p", "p", ()), (2, "q", "Q", ("r",))]
    texts = ['```json\n{"a": 1}\n```', 'So: {"a": {"b": 2}} ok', "nothing", '{"a": ', None, "[1]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(catalog.json_extract(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, "[1]"]


GAZ = "level string, value string, rank int, display_name string, importance double, addresstype string, place_city string, place_country string, place_region string"


@pytest.mark.parametrize("second,kind,status", [(0.46, "city", "unresolved"), (0.44, "city", "resolved"), (0.44, "river", "unresolved")])
def test_gazetteer_margin_and_kind(spark, second, kind, status):
    gaz = spark.createDataFrame([("city", "L", 1, "L1", 0.5, kind, "L", "UK", "R"), ("city", "L", 2, "L1", 0.5, kind, "L", "UK", "R"), ("city", "L", 3, "L3", second, "city", "M", "UK", "R")], GAZ)
    loc = spark.createDataFrame([(1, "real", "England", None, "L", None, None, None, None, None, None, None), (2, "real", "England", None, None, None, None, None, None, None, None, None), (3, "fictional", None, None, "L", None, None, None, None, None, None, None)], LOC)
    got = {r.location_id: r for r in places.geo_backfill(loc, gaz).collect()}
    assert (got[1].geocode_status, got[2].geocode_status, got[3].geocode_status) == (status, "unresolved", "skipped")
    if status == "resolved":
        assert (got[1].country, got[1].region) == ("UK", "R")
        assert places.geo_backfill(loc, gaz, overwrite=False).filter("location_id = 1").first().country == "England"


def test_evidence_keeps_first_and_last(spark):
    df = spark.range(11).select(F.lit("b").alias("book_id"), F.lit(1).alias("character_id"), F.col("id").alias("event_id"), F.col("id").alias("chapter"), F.lit(1).alias("narration_order"))
    assert sorted(r.event_id for r in people.evidence_sample(df).collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_usage(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 0, 0, 0, False), ("m", 5, 5, 5, 5, True), ("unknown", 9, 9, 9, 9, False)], "model string, input_tokens long, cache_write_tokens long, cache_read_tokens long, output_tokens long, cli boolean")
    got = {r.model: (r.calls, r.cost) for r in ranking.usage_summary(calls, spark.createDataFrame([("m", 5.0, 25.0)], "model string, input_rate double, output_rate double")).collect()}
    assert got == {"m": (2, 5.0), "unknown": (1, 0.0)}


def test_pageviews_window(spark):
    today = datetime.date(2024, 1, 3)
    views = spark.createDataFrame([("p", datetime.date(2024, 1, 1), 3), ("p", datetime.date(2024, 1, 2), 9)], "page string, day date, views int")
    got = {r.page: r.views for r in ranking.pageviews_sum(views, spark.createDataFrame([("p",), ("q",)], "page string"), today).collect()}
    assert got == {"p": 3, "q": 0}


def test_flags(spark):
    flags = spark.createDataFrame([("f", "b", ["A", "B"], "A", "likely", "pending"), ("g", "b", ["A", "Z"], "A", "likely", "pending"), ("h", "b", ["A"], "A", "likely", "rejected")], "flag_id string, book_id string, character_ids array<string>, canonical_id string, confidence string, status string")
    chars = spark.createDataFrame([("b", "A", "Ann", ["x"]), ("b", "B", "Bob", ["Ann"])], "book_id string, character_id string, canonical_name string, aliases array<string>")
    events = spark.createDataFrame([("b", "B")], "book_id string, character_id string")
    books = spark.createDataFrame([("b", "T")], "book_id string, title string")
    assert {r.flag_id: r.members for r in people.flags_pending(flags, books, chars).collect()} == {"f": "Ann, Bob", "g": "Ann, ?"}
    dated = flags.withColumn("created_at", F.when(F.col("flag_id") == "f", F.lit("2026-01-02")).otherwise(F.lit("2026-01-01")))
    assert [r.flag_id for r in people.flags_pending(dated, books, chars).collect()] == ["g", "f"]
    f, c, e = people.flag_approve("f", flags, chars, events)
    assert {r.flag_id: r.status for r in f.collect()}["f"] == "approved" and [(r.character_id, r.aliases) for r in c.collect()] == [("A", ["Bob", "x"])] and e.first().character_id == "A"
    assert {r.flag_id: r.status for r in people.flag_reject("h", people.flag_reject("f", flags)).collect()} == {"f": "rejected", "g": "pending", "h": "rejected"}


def test_store_is_atomic(spark, tmp_path):
    books = spark.createDataFrame([("b",)], "book_id string")
    chars = spark.createDataFrame([("b", "A")], "book_id string, character_id string")
    locs = spark.createDataFrame([(1, "real", "E", None, None, None, None, None, None, None, None, None)], LOC).withColumn("book_id", F.lit("b")).withColumn("transport_detail", F.lit(None).cast("string"))
    events = spark.createDataFrame([("b", "A", 1)], "book_id string, character_id string, location_id long")
    tables = {"books": books, "characters": chars, "locations": locs, "events": events}
    root = str(tmp_path / "store")
    store.save_books(tables, root, "r1")
    store.save_books(tables, root, "r2", replaces="r1")
    assert [r.run_id for r in store.load(spark, root, "events").collect()] == ["r2"]
    with pytest.raises(ValueError):
        store.save_books(tables | {"characters": chars.limit(0)}, root, "r3")
    with pytest.raises(Exception, match="unknown character_id"):
        store.id_remap(events, spark.createDataFrame([("b", "Q", "q")], "book_id string, old_id string, new_id string"), "character_id").collect()


def test_injected_models(spark):
    tries, waits = [], []

    def busy(row):
        tries.append(row)
        raise models.ServiceError(529)

    with pytest.raises(models.ServiceError):
        models.with_retries(busy, sleep=waits.append)({})
    assert len(tries) == 3 and waits == [15, 60]
    df = spark.createDataFrame([("b", 2, "two"), ("b", 1, "one")], "book_id string, chapter long, text string")
    assert sorted(r.n for r in models.answers(df, lambda r: {"n": len(r["text"])}, "n long").collect()) == [3, 3]

    def call(t, registry, chapter):
        registry = {"characters": [*registry["characters"], t], "locations": []}
        return {"rows": [{"chapter": chapter, "known": ",".join(registry["characters"])}], "registry": registry}

    got = models.fold_chapters(df, call, "chapter long, known string").orderBy("chapter").collect()
    assert [r.known for r in got] == ["one", "one,two"]


def test_budget_and_throttle():
    call = models.with_budget(lambda r: {"cost": 0.4}, lambda a: a["cost"], 1.0)
    assert [call({})["cost"] for _ in range(3)] == [0.4] * 3
    with pytest.raises(models.BudgetSpent):
        call({})
    now, waits = [0.0], []
    slow = models.throttled(lambda r: r, 1.0, clock=lambda: now[0], sleep=waits.append)
    for at in (0.0, 0.25, 5.0):
        now[0] = at
        slow({})
    assert waits == [0.75]


def test_whole_text_files(spark, tmp_path):
    for n, t in (("a", "one\n\ntwo\n"), ("b", "three é")):
        (tmp_path / f"{n}.txt").write_text(t, encoding="utf-8")
    got = catalog.read_texts(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.text) for r in got) == [("a.txt", "one\n\ntwo\n"), ("b.txt", "three é")]
    with pytest.raises(AnalysisException):
        catalog.read_texts(spark, f"{tmp_path}/none").collect()


def test_chapters_are_numbered_without_a_shuffle(spark):
    df = text.split_chapters(spark.createDataFrame([("b", "CHAPTER 1\n\none\n\nCHAPTER 2\n\n \n\nCHAPTER 3\n\nthree\n\nmore"), ("c", None), ("d", "no heading")], "book_id string, text string"))
    assert [tuple(r) for r in df.orderBy("book_id", "chapter").collect()] == [("b", 1, "CHAPTER 1", ["one"]), ("b", 2, "CHAPTER 3", ["three", "more"]), ("d", 1, None, ["no heading"])]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_stream_of_events(spark, tmp_path):
    locs = spark.createDataFrame([(1, "real", " E ", None, None, None, None, None, None, None, None, None)], LOC)
    schema = "event_id long, book_id string, character_id long, location_id long, time_precision string, time_year int, time_month int, time_day int, time_year_range_start int, time_year_range_end int"
    spark.createDataFrame([(1, "a", 1, 1, "year", 1800, None, None, None, None), (2, "a", 1, 1, None, 1800, None, None, None, None)], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        append_points(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), locs, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert [(r.event_id, r.country) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "e")]
