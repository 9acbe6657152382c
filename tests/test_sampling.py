"""Drawing without listing: same law as drawing from a list, and cost that doesn't follow the pairs."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F
from test_core import POINT, pts

from chronotopia.operators import encounters, sampling

PAIR = [f"{c}_{s}" for s in "ab" for c in ("event_id", "point_role")]


def some_points(spark, n, seed=3):
    """Points with unknowns, ranges that share several units, and ranges that end before they begin."""
    rng = random.Random(seed)
    some = lambda *x: rng.choice([None, *x])
    rows = []
    for _ in range(n):
        y = rng.randint(1795, 1806)
        z = y + rng.choice([0, 0, 0, 3, 15, -2])
        rows.append((rng.choice(["a", "b", "b", "c", None]), some(y, y, y), some(z, z, z), some(1, 2), some(1, 2), some("x", "y"), some("r"), some("c", "d"), some("n")))
    return pts(spark, *rows).cache()


def likeliest(n, k):
    """How far the most and least frequent of n equally likely things may lie from k / n draws (6 deviations)."""
    return k / n + 6 * (k / n) ** 0.5 + 1


@pytest.mark.parametrize("time_, location, n", [("year", "city", 130), ("day", "none", 120), ("decade", "region", 100), ("none", "none", 30)])
def test_every_pair_is_equally_likely(spark, time_, location, n):
    p = some_points(spark, n)
    want = {tuple(r) for r in encounters.pairs(p, time_, location).select(*PAIR).collect()}
    rng = random.Random(1)
    numbers = [(i, rng.randrange(sampling.WHOLE)) for i in range(6000)]
    drawn, _ = sampling.drawn_pairs(p, time_, location, None, numbers)
    got = collections.Counter(tuple(r) for r in drawn.select(*PAIR).collect())
    assert set(got) <= want and len(got) > 0.9 * len(want) > 10
    assert max(got.values()) <= likeliest(len(want), sum(got.values()))


def test_every_encounter_is_equally_likely(spark):
    """One character with many events in a place against others with one: taken draws prefer nobody."""
    y = (1800, 1800, None, None, "x", None, "c", None)
    p = pts(spark, *[("a", *y)] * 12, *[("b", *y)] * 6, ("c", *y)).withColumn("character_id", F.when(F.col("event_id") < 10, 0).otherwise(F.col("event_id")))
    names = p.selectExpr("event_id", "book_id", "book_id book_title", "cast(character_id as string) character_name", "'here' readable_location", "'then' readable_time", "cast(null as string) evidence_quote", "'real' location_type", "country", "region", "city", "country transit_to_country", "city transit_to_city")
    groups = encounters.encounters(p, names, "year", "city")
    want = {(r.character_id_a, r.character_id_b): r.support_count for r in groups.collect()}
    assert len(want) == 3 * 7 + 6 and max(want.values()) == 10
    rng = random.Random(2)
    drawn, _ = sampling.drawn_pairs(p, "year", "city", None, [(i, rng.randrange(sampling.WHOLE)) for i in range(4000)])
    tried = sampling._supports(drawn, p, names, "year", "city").collect()
    assert len(tried) == 4000 and all(want[(r.character_id_a, r.character_id_b)] == r.support_count for r in tried)
    taken = collections.Counter((r.character_id_a, r.character_id_b) for r in tried if rng.random() * r.support_count < 1)
    assert set(taken) == set(want) and max(taken.values()) <= likeliest(len(want), sum(taken.values()))
    one = [sampling.random_encounter(p, names, "year", "city", seed=s).first() for s in (1, 1, 2)]
    assert one[0] == one[1] and want[(one[2].character_id_a, one[2].character_id_b)] == one[2].support_count


@pytest.mark.parametrize("time_, location", [("year", "city"), ("none", "none")])
def test_the_cap_keeps_each_pair_alike(spark, time_, location):
    p = some_points(spark, 120)
    want = {tuple(r) for r in encounters.pairs(p, time_, location).select(*PAIR).collect()}
    cap, kept = len(want) // 5, collections.Counter()
    for seed in range(3):
        got = [tuple(r) for r in sampling.bernoulli_pairs(p, time_, location, seed=seed, cap=cap).select(*PAIR).collect()]
        assert len(set(got)) == len(got) and set(got) <= want and abs(len(got) - cap) < 6 * cap**0.5
        kept.update(got)
    assert kept.most_common(1)[0][1] <= 3 and len(kept) > 0.35 * len(want)
    again = [tuple(r) for r in sampling.bernoulli_pairs(p, time_, location, seed=2, cap=cap).select(*PAIR).collect()]
    assert sorted(again) == sorted(got)
    assert sampling.bernoulli_pairs(p, time_, location, cap=len(want)).count() == len(want)


def test_nothing_to_draw(spark):
    none = pts(spark, ("a", 1, 1, None, None, None, None, "c", None), ("b", 2, 2, None, None, None, None, "c", None), ("c", 9, 5, None, None, None, None, "d", None), ("d", 8, 6, None, None, None, None, "d", None))
    names = none.selectExpr("event_id", "book_id book_title", "'n' character_name", "'l' readable_location", "'t' readable_time", "'e' evidence_quote", "'real' location_type", "country", "region", "city", "country transit_to_country", "city transit_to_city")
    # No two of one city share a year; two ranges that end before they begin share units but don't meet.
    assert sampling.random_encounter(none, names, "year", "city").collect() == []
    assert sampling.random_encounter(none.limit(0), names, "none", "none").collect() == []
    with pytest.raises(ValueError):
        sampling.random_encounter(none, names, "week", "city")


def test_cost_does_not_follow_the_pairs(spark):
    """100 times the pairs, and a pair of books that has none: the same draws, in about the same time."""
    y = [F.lit(v).cast(k).alias(c) for c, v, k in (("y_start", 1800, "int"), ("y_end", 1800, "int"), ("time_month", None, "int"), ("time_day", None, "int"), ("location_id", 1, "long"), ("point_role", "place", "string"), ("country", "x", "string"), ("region", None, "string"), ("city", "c", "string"), ("neighborhood", None, "string"))]
    took, cols = [], [c.split()[0] for c in POINT.split(", ")]
    for n in (4_000, 40_000):
        p = spark.range(n).select(F.col("id").alias("event_id"), F.concat(F.lit("b"), F.col("id") % 2).alias("book_id"), (F.col("id") % 100).alias("character_id"), *y).select(*cols).cache()
        assert p.count() == n
        began = time.time()
        got = sampling.bernoulli_pairs(p, "year", "city", cap=500).collect()
        took.append(time.time() - began)
        assert abs(len(got) - 500) < 150 and all(r.book_id_a < r.book_id_b for r in got)
    assert took[1] < 4 * took[0] + 10


@pytest.mark.parametrize("limit", [3, 40, 2000])
def test_first_common_years_are_those_of_the_whole_list(spark, limit):
    p = some_points(spark, 150, seed=9)
    names = p.selectExpr("event_id", "concat('n', event_id % 7) character_name")
    key = lambda r: tuple((v is None, v if v is not None else "") for v in (r.overlap_start, r.overlap_end, r.character_a, r.character_b, r.place))
    whole = sorted(encounters.overlap_years(p, names, "city", None).collect(), key=key)
    got = encounters.overlap_years(p, names, "city", limit).collect()
    assert got == whole[:limit] and len(whole) > 40 and any(r.overlap_start is None for r in whole)


def test_books_of_one_title(spark):
    y = (1800, 1800, None, None, "x", None, "c", None)
    p = pts(spark, ("a", *y), ("a", *y), ("b", *y), ("c", *y), ("d", *y), ("e", *y))
    books = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "U"), ("d", None)], "book_id string, title string")
    r = encounters.same_book_check(p, books).first()
    assert (r.total, r.same_book) == (9, 2)
