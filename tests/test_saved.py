"""Books of clashing working ids, saved and asked; replacing and removing single books."""

import pytest
from test_process import COLUMNS, NUMBERS, event

from chronotopia.operators import encounters, points
from chronotopia.plans import saved
from chronotopia.plans.process import Services, process_and_save
from chronotopia.sources import store

LOCATION = "book_id string, location_id string, location_type string, country string, region string, city string, neighborhood string, street string, transit_from_country string, transit_from_city string, transit_to_country string, transit_to_city string, transport_mode string, transport_detail string"
EVENT = "event_id string, book_id string, character_id string, location_id string, time_precision string, time_year int, time_month int, time_day int, time_year_range_start int, time_year_range_end int, time_source string, evidence_quote string"


def book(spark, source, city, year=1872, who="alice"):
    """Tables of a book with one person, who is in one place once."""
    return {
        "books": spark.createDataFrame([(source, f"Book {source}")], "book_id string, title string"),
        "characters": spark.createDataFrame([(source, who, f"{who} of {source}", [])], "book_id string, character_id string, canonical_name string, aliases array<string>"),
        "locations": spark.createDataFrame([(source, "loc_1", "real", "x", None, city, *[None] * 8)], LOCATION),
        "events": spark.createDataFrame([(f"{source}_1", source, who, "loc_1", "year", year, None, None, None, None, "stated", None)], EVENT),
        "character_duplicate_flags": spark.createDataFrame([("f", source, [who, who], who, "likely", "pending")], "flag_id string, book_id string, character_ids array<string>, canonical_id string, confidence string, status string"),
    }


def save(spark, root, run, *books, **how):
    tables = [store.lasting_ids(b, run) for b in books]
    store.save_books({n: _all([t[n] for t in tables]) for n in tables[0]}, root, run, **how)


def _all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def met(spark, root, time="year", location="city"):
    found = encounters.encounters(saved.match_points(spark, root), saved.readable(spark, root), time, location)
    return sorted((*sorted([r.character_a, r.character_b]), r.support_count) for r in found.collect())


def test_clashing_ids_give_no_false_encounter(spark, tmp_path):
    """Two novels through the whole pipeline: each has an alice and a loc_1; they meet where their places are the same only."""
    novel = "CHAPTER I\n\nOnce.\n\nCHAPTER II\n\nThen."
    novels = spark.createDataFrame([("a", "A", novel), ("b", "B", novel)], "book_id string, title string, text string")
    rows = [event("a", 1, 0, "alice", 1872, country="England", city="London"), event("b", 1, 0, "alice", 1872, country="France", city="Paris"),
            event("b", 2, 0, "alice", 1880, country="England", city="London"), event("a", 2, 0, "alice", 1880, country="England", city="London")]
    schema = ", ".join(f"{c} {'int' if c in NUMBERS else 'string'}" for c in COLUMNS)
    services = Services(
        declare=lambda ch: ch.selectExpr("book_id", "chapter", "'[{\"id\": \"alice\", \"canonical_name\": \"Alice\", \"aliases\": []}]' new_characters").filter("chapter = 1"),
        events=lambda ch: spark.createDataFrame(rows, schema),
        estimate=lambda opening: opening.selectExpr("book_id", "cast(null as int) year_range_start", "cast(null as int) year_range_end", "'low' setting_confidence"),
        duplicates=lambda context: spark.createDataFrame([], "book_id string, position int, canonical_id string, character_ids array<string>, confidence string"),
        gazetteer=spark.createDataFrame([], "level string, value string, rank int, display_name string, importance double, addresstype string, place_city string, place_country string, place_region string"),
    )
    root = str(tmp_path)
    process_and_save(novels, services, root, "r1")
    p = saved.match_points(spark, root)
    assert p.count() == 4 and len({r.character_id for r in p.collect()}) == 2
    found = encounters.encounters(p, saved.readable(spark, root), "year", "city").collect()
    assert [(r.location_a, r.time_a, r.support_count) for r in found] == [("London, England", "1880", 1)]
    one = saved.request(spark, root, "year", "city", "england").first()
    assert {one.book_a, one.book_b} == {"A", "B"} and one.time_a == "1880"
    with pytest.raises(ValueError):
        saved.request(spark, root, country="france")  # only one book is there


def test_working_ids_join_inside_their_book(spark):
    """Tables that were never saved: places are told apart by their book, people too."""
    a, b = book(spark, "a", "London"), book(spark, "b", "Paris")
    both = {n: a[n].unionByName(b[n]) for n in a}
    p = points.event_match_points(both["events"], both["locations"])
    r = points.event_readable(*(both[n] for n in ("events", "books", "characters", "locations")))
    assert sorted((x.book_id, x.city) for x in p.collect()) == [("a", "london"), ("b", "paris")]
    assert r.count() == 2 and encounters.encounters(p, r, "year", "city").count() == 0 and encounters.encounters(p, r, "year", "country").count() == 1
    # Three books whose people share an id make three groups, not one.
    c = book(spark, "c", "London")
    three = {n: both[n].unionByName(c[n]) for n in a}
    p = points.event_match_points(three["events"], three["locations"])
    r = points.event_readable(*(three[n] for n in ("events", "books", "characters", "locations")))
    assert [g.support_count for g in encounters.encounters(p, r, "year", "country").collect()] == [1, 1, 1]
    assert encounters.encounter_groups(encounters.pairs(p, "year", "country"), r, encounters.drawn(1, *encounters.PAIR)).count() == 3


def test_replacing_and_removing_a_book(spark, tmp_path):
    root = str(tmp_path)
    save(spark, root, "r1", book(spark, "a", "London"), book(spark, "b", "London"), book(spark, "c", "Paris"))
    assert met(spark, root) == [("alice of a", "alice of b", 1)]
    save(spark, root, "r2", book(spark, "b", "Paris", who="bob"), replace_books=True)
    assert met(spark, root) == [("alice of c", "bob of b", 1)]
    # The rest of the first run stays; a version that is not a replacement is a book of its own.
    assert sorted((r.run_id, r.source_book_id) for r in store.load(spark, root, "books").collect()) == [("r1", "a"), ("r1", "c"), ("r2", "b")]
    save(spark, root, "r3", book(spark, "a", "London"))
    assert met(spark, root) == [("alice of a", "alice of a", 1), ("alice of c", "bob of b", 1)]
    store.remove_books(spark, root, "a")
    assert met(spark, root) == [("alice of c", "bob of b", 1)]
    saved.create_views(spark, root)
    assert spark.sql("SELECT count(*) AS n FROM event_match_points p JOIN event_readable r USING (event_id)").first().n == 2
    save(spark, root, "r4", book(spark, "d", "Paris"))
    saved.create_views(spark, root)
    assert spark.sql("SELECT count(*) AS n FROM event_match_points").first().n == 3


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    bad = book(spark, "a", "London")
    bad["character_duplicate_flags"] = bad["character_duplicate_flags"].selectExpr("flag_id", "book_id", "array('alice', 'nobody') character_ids", "canonical_id", "confidence", "status")
    with pytest.raises(ValueError, match="flags"):
        save(spark, root, "r1", bad)
    save(spark, root, "r1", book(spark, "a", "London"))
    flag = store.load(spark, root, "character_duplicate_flags").first()
    assert flag.character_ids == [flag.canonical_id] * 2 == [store.load(spark, root, "characters").first().character_id] * 2


def test_members_are_remapped_in_order(spark):
    flags = spark.createDataFrame([("b", 1, ["z", "a", "z"]), ("b", 2, []), ("b", 3, None), ("c", 1, ["a"])], "book_id string, flag_id int, character_ids array<string>")
    ids = spark.createDataFrame([("b", "a", "1"), ("b", "z", "26"), ("c", "a", "3")], "book_id string, old_id string, new_id string")
    got = {(r.book_id, r.flag_id): r.character_ids for r in store.id_remap_members(flags, ids, "character_ids", "flag_id").collect()}
    assert got == {("b", 1): ["26", "1", "26"], ("b", 2): [], ("b", 3): None, ("c", 1): ["3"]}
    with pytest.raises(Exception, match="unknown _member"):
        store.id_remap_members(flags, ids.filter("old_id = 'a'"), "character_ids", "flag_id").collect()
