"""Snapshot refinement: what is offered follows what is asked, and no place travels with an offer."""

import random

from chronotopia.functions.vocabulary import HIERARCHY
from chronotopia.operators import places
from tests.test_refinement import TIME, fits, level, table


def test_as_by_comparing_all_with_all(spark):
    rng, rows = random.Random(4), []
    for n in range(160):
        pick = lambda *x: rng.choice([None, *x])
        r = {"event_id": n, "book_id": rng.choice("ab"), "character_id": n % 3, "ordinal": n, "location_type": rng.choice(["real", "real", "real", "transit"])}
        r |= dict(zip(HIERARCHY, (pick("x"), pick("r"), pick("c", "d"), pick("n"), pick("s")))) | {c: None for c in TIME}
        r |= {"time_year": pick(1800, 1801), "time_month": pick(1, 2), "time_year_range_start": rng.choice([None, None, None, 1801]), "source": f"s{n}"}
        rows.append(r)
    want = {}
    for r in rows:
        near = [s for s in rows if (s["book_id"], s["character_id"]) == (r["book_id"], r["character_id"]) and fits(r, s)]
        best = max(near, key=lambda s: (level(s), sum(s[c] is not None for c in HIERARCHY), -s["ordinal"]), default=r)
        want[r["event_id"]] = (*[best[c] for c in HIERARCHY], best["source"])
    got = {r.event_id: (*[r[c] for c in HIERARCHY], r.source) for r in places.refine_locations(table(spark, rows)).collect()}
    assert got == want and sum(w[-1] != f"s{n}" for n, w in want.items()) > 30


def test_nothing_is_offered_under_a_place_that_nobody_asks_for(spark, monkeypatch):
    """All places of the character are cities: no event asks, so the table of offers is empty; a rank is one number."""
    rows = [{"event_id": n, "book_id": "a", "character_id": 1, "ordinal": n, "location_type": "real", "country": "x", "region": "r", "city": f"c{n}"} for n in range(4)]
    out = places.refine_locations(table(spark, rows))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "bit_or" in plan
    assert {r.event_id: r.city for r in out.collect()} == {n: f"c{n}" for n in range(4)}
