"""Groups given as their pairs are joined, and the most supported ones without listing all."""

import random

import pytest
from pyspark.sql import functions as F

from chronotopia.operators import encounters
from tests.test_core import pts


def some(spark, n, seed=1):
    """Points of few characters, so that sides have several units and points, and readable rows in which places and months are hidden."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = []
    for _ in range(n):
        y = 1800 + rng.randrange(6)
        rows.append((pick("a", "b", "c", None), y, y + pick(0, 0, 5), pick(None, 1, 2), None, pick(None, "x", "y"), pick(None, "r"), pick(None, "p", "q"), pick(None, "n", "m")))
    p = pts(spark, *rows).withColumn("character_id", F.col("event_id") % 3).withColumn("event_id", F.floor(F.col("event_id") / 2))
    # Both points of an event are of one character and book.
    one = p.groupBy("event_id").agg(*[F.first(c).alias(f"_{c}") for c in ("book_id", "character_id")])
    p = p.join(one, "event_id").withColumns({"book_id": F.col("_book_id"), "character_id": F.col("_character_id")}).drop("_book_id", "_character_id").localCheckpoint()
    r = p.groupBy("event_id").agg(*[F.min(c).alias(c) for c in ("book_id", "country", "region", "city")])
    shown = F.concat(F.lit("place "), (F.col("event_id") % 2).cast("string"))
    r = r.select("event_id", "book_id", F.col("book_id").alias("book_title"), F.lit("N").alias("character_name"), shown.alias("readable_location"), F.when(F.col("event_id") % 5 > 0, "then").alias("readable_time"),
                 F.col("event_id").cast("string").alias("evidence_quote"), F.lit("real").alias("location_type"), "country", "region", "city", F.lit(None).cast("string").alias("transit_to_country"), F.lit(None).cast("string").alias("transit_to_city"))
    return p, r.localCheckpoint()


CASES = [("year", "city"), ("month", "neighborhood"), ("decade", "country"), ("none", "none")]


@pytest.mark.parametrize("listed", [1, 16, 64])
@pytest.mark.parametrize("time, location", CASES)
def test_groups_are_as_grouped_pairs(spark, monkeypatch, time, location, listed):
    p, r = some(spark, 120)
    monkeypatch.setattr(encounters, "LISTED", listed)
    cols = ["character_id_a", "character_id_b", "event_id_a", "event_id_b", "evidence_a", "evidence_b", "time_a", "support_count"]
    got = sorted(map(str, encounters.encounters(p, r, time, location).select(*cols).collect()))
    want = sorted(map(str, encounters.encounter_groups(encounters.pairs(p, time, location), r, F.lit(0)).select(*cols).collect()))
    assert got == want and len(got) > 5


@pytest.mark.parametrize("time, location", CASES)
@pytest.mark.parametrize("first", [1, 1 << 22])
def test_most_supported_are_the_first_of_all(spark, monkeypatch, time, location, first):
    p, r = some(spark, 160, 2)
    monkeypatch.setattr(encounters, "FIRST_PAIRS", first)
    order = [F.desc("support_count"), "event_id_a", "event_id_b"]
    for limit in (3, 1000):
        want = encounters.encounters(p, r, time, location).orderBy(*order).limit(limit).collect()
        assert encounters.most_supported(p, r, time, location, limit=limit).collect() == want


def test_pairs_of_sides_are_not_shuffled(spark):
    p, r = some(spark, 60)
    plan = encounters.encounters(p, r, "year", "city")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Join Inner")[0]
    assert "Aggregate" not in top and "Window" not in top


def test_levels_that_both_know_are_keys(spark):
    """A place with a country is compared with those of its country and those without one, not with all of the city."""
    p, _ = some(spark, 20)
    plan = encounters.pairs(p, "day", "neighborhood")._jdf.queryExecution().executedPlan().toString()
    assert all(f"w_{c}" in line for c in ("country", "region", "city") for line in plan.splitlines() if "Join" in line)


def test_nobody_meets(spark):
    p, r = some(spark, 20)
    assert encounters.most_supported(p.filter("book_id = 'a'"), r).count() == 0
    assert encounters.most_supported(p.limit(0), r).count() == 0
