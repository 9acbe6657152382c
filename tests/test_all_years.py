"""All common years: classes of names give each row once, and no pairs are shuffled."""

import pytest
from pyspark.sql import functions as F

from chronotopia.operators import encounters
from tests.test_sampling import some_points


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("units, spans, names, n", [(32, 512, 60, 300), (32, 512, 9, 250), (2, 512, 30, 250), (32, 20, 30, 250)])
def test_rows_are_those_of_listed_pairs(spark, monkeypatch, units, spans, names, n):
    """Few names have several units each in several books; names of too many units or of odd ranges go the other way."""
    monkeypatch.setattr(encounters, "UNITS", units)
    monkeypatch.setattr(encounters, "SPANS", spans)
    p = some_points(spark, n, seed=11)
    shown = p.selectExpr("event_id", f"nullif(concat('n', event_id % {names}), 'n1') character_name")
    named = p.join(shown, "event_id").alias("a"), p.join(shown, "event_id").alias("b")
    same = encounters.time_condition("year") & encounters.location_condition("city") & (F.col("a.book_id") < F.col("b.book_id"))
    want = named[0].join(named[1], same).select(*[F.col(f"{s}.character_name").alias(f"character_{s}") for s in "ab"], *encounters._common("city")).distinct()
    got = encounters.overlap_years(p, shown, "city", None)
    assert got.columns == want.columns and rows(got) == rows(want) and want.count() > 50


def test_pairs_are_not_shuffled(spark):
    p = some_points(spark, 60).filter("y_start <= y_end")
    shown = p.selectExpr("event_id", "concat('n', event_id) character_name")
    plan = encounters.overlap_years(p, shown, "city", None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join Inner")[0]
