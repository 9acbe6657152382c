"""Refinement event by event against a plain loop."""

import random

from chronotopia.functions.vocabulary import HIERARCHY, PLACE, TIME
from chronotopia.operators import places

INTS = {*TIME}
SCHEMA = ", ".join(["event_id long", "book_id string", "character_id long", "ordinal int", *[f"{c} int" for c in TIME], *[f"{c} string" for c in PLACE], "`_at` string", "`odd.name` map<string,int>"])
COLS = ["event_id", "book_id", "character_id", "ordinal", *TIME, *PLACE]


def table(spark, rows):
    return spark.createDataFrame([(*(r.get(c) for c in COLS), "x", {"k": r["event_id"]}) for r in rows], SCHEMA)


def year_fits(ranged, other):
    start, end, year = ranged["time_year_range_start"], ranged["time_year_range_end"], other["time_year"]
    if (start is None and end is None) or other["time_year_range_start"] is not None or other["time_year_range_end"] is not None or year is None:
        return True
    return (start is None or start <= year) and (end is None or year <= end)


def level(r):
    return max([n for n, c in enumerate(HIERARCHY) if r[c] is not None], default=-1)


def fits(r, s):
    if "transit" in (r["location_type"], s["location_type"]) or level(s) <= level(r):
        return False
    if any(r[c] is not None and r[c] != s[c] for c in HIERARCHY) or any(None not in (r[c], s[c]) and r[c] != s[c] for c in TIME[2:]):
        return False
    return year_fits(r, s) and year_fits(s, r)


def by_loop(rows):
    rows = [dict(r) for r in rows]
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        near = [s for s in rows if s is not r and (s["book_id"], s["character_id"]) == (r["book_id"], r["character_id"]) and fits(r, s)]
        if near:
            best = max(near, key=lambda s: (level(s), sum(s[c] is not None for c in HIERARCHY), -s["ordinal"]))
            r.update({c: best[c] for c in PLACE})
    return {r["event_id"]: tuple(r[c] for c in PLACE) for r in rows}


def random_events(seed, n, people=2, open_ended=0.3):
    rng = random.Random(seed)
    maybe = lambda p, v: v if rng.random() < p else None
    rows = []
    for i in range(n):
        r = dict.fromkeys(COLS) | {"event_id": i, "ordinal": i, "book_id": maybe(0.9, "b"), "character_id": rng.randrange(people)}
        r |= {c: maybe(0.55, f"{c}{rng.randrange(2)}") for c in HIERARCHY}
        r |= {"location_type": rng.choice(["real", "real", "real", "fictional", "transit", None]), "source": f"s{i}", "proximity": maybe(0.5, f"p{i}")}
        r |= {"time_month": maybe(0.3, rng.randint(1, 2)), "time_day": maybe(0.2, rng.randint(1, 2))}
        year = rng.randint(-3, 20)
        if rng.random() < 0.5:
            r |= {"time_year_range_start": maybe(1 - open_ended, year), "time_year_range_end": maybe(1 - open_ended, year + rng.randint(-1, 12))}
        r["time_year"] = maybe(0.6, rng.randint(-3, 20))
        rows.append(r)
    return rows


def found(df):
    return {r["event_id"]: tuple(r[c] for c in PLACE) for r in df.collect()}


def test_refinement_in_order_is_as_a_loop(spark):
    for seed, n, people in ((1, 150, 3), (2, 90, 1), (3, 1, 1)):
        rows = random_events(seed, n, people)
        df = table(spark, rows[::-1])
        out = places.refine_locations(df, "sequential")
        assert out.columns == df.columns and out.count() == n
        assert found(out) == by_loop(rows)
        assert {(r["_at"], r["odd.name"]["k"] == r["event_id"]) for r in out.collect()} == {("x", True)}


def test_replacements_that_build_on_one_another(spark):
    # Dates agree with their neighbours only, so each event learns from the one before.
    blank = dict.fromkeys(COLS)
    rows = [blank | {"event_id": 0, "ordinal": 0, "book_id": "b", "location_type": "real", "country": "E", "city": "C", "street": "S", "time_year": 1, "source": "s"}]
    dates = [{"time_year": 1, "time_month": 1}, {"time_month": 1, "time_day": 2}, {"time_year": 2, "time_day": 2}, {"time_year": 2, "time_month": 3}, {"time_month": 3, "time_day": 4}, {"time_year": 5, "time_day": 4}]
    rows += [blank | {"event_id": i, "ordinal": i, "book_id": "b", "location_type": "real", "country": "E", "source": f"s{i}"} | d for i, d in enumerate(dates, 1)]
    want = by_loop(rows)
    assert {v[-1] for v in want.values()} == {"s"}
    assert found(places.refine_locations(table(spark, rows), "sequential")) == want


def test_one_ordinal_many_equal_events_and_none(spark):
    blank = dict.fromkeys(COLS) | {"book_id": "b", "character_id": 1, "ordinal": 7, "location_type": "real", "country": "E"}
    rows = [blank | {"event_id": i} for i in range(50)] + [blank | {"event_id": 99, "city": "C", "source": "s"}]
    assert {v[3] for v in found(places.refine_locations(table(spark, rows), "sequential")).values()} == {"C"}
    assert places.refine_locations(table(spark, []), "sequential").collect() == []
    journeys = [blank | {"event_id": 1, "location_type": "transit"}]
    assert found(places.refine_locations(table(spark, journeys), "sequential"))[1][0] == "transit"
