"""Pairs are written out from lists of points that meet, not joined one by one."""

import pytest
from pyspark.sql import functions as F

from chronotopia.operators import encounters
from tests.test_core import pts
from tests.test_sampling import some_points

CASES = [("year", "city"), ("day", "neighborhood"), ("month", "none"), ("century", "region"), ("none", "neighborhood")]


@pytest.mark.parametrize("size", [1, 3, 64])
@pytest.mark.parametrize("time, location", CASES)
def test_pairs_of_lists_are_those_of_points(spark, monkeypatch, time, location, size):
    monkeypatch.setattr(encounters, "LIST", size)
    p = some_points(spark, 130)
    cols = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("event_id", "book_id", "character_id", "location_id", "point_role")]
    want = sorted(tuple(map(str, r)) for r in encounters._joined(p, time, location).select(*cols).collect())
    assert sorted(tuple(map(str, r)) for r in encounters.pairs(p, time, location).collect()) == want and len(want) > 20


def test_lists_meet_and_are_dealt_once(spark):
    """2,000 points in one place and year are 32 lists; the join gives 256 pairs of lists of the million pairs."""
    one = pts(spark, ("a", 1800, 1800, None, None, "x", None, "c", None))
    p = one.crossJoin(spark.range(2000)).withColumns({"event_id": F.col("id"), "book_id": F.concat(F.lit("b"), F.col("id") % 2)}).drop("id")
    own = encounters._lists(p, "year", "city", ["city", "known", "w_country", "w_region", "bucket"], ["event_id"]).filter("_own = 1 AND _other = 1")
    sizes = [r[0] for r in own.select(F.size("items")).collect()]
    assert len(sizes) == 32 and sum(sizes) == 2000 and max(sizes) <= encounters.LIST
    found = encounters.pairs(p, "year", "city")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join Inner")[0].count("Generate inline") == 2
    # Both sides read one deal of the lists.
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = encounters.pairs(p, "year", "city")
        assert len(found.collect()) == 1_000_000
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
