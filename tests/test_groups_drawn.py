"""What drawing keeps follows groups and drawn characters, not points and events."""

from pyspark.sql import functions as F

from chronotopia.operators import sampling
from tests.test_core import pts


def many(spark, n):
    """n points of two books in one city and year."""
    one = pts(spark, ("a", 1800, 1800, None, None, "x", None, "c", None))
    return one.crossJoin(spark.range(n)).withColumns({"event_id": F.col("id"), "book_id": F.concat(F.lit("b"), F.col("id") % 2), "character_id": F.col("id") % 100}).drop("id")


def test_groups_are_numbered_not_bins(spark):
    p = many(spark, 2000)
    drawn, state = sampling.drawn_pairs(p, "year", "city", None, [(0, 5), (1, sampling.WHOLE - 1)])
    assert state[0].count() <= 16 and state[1] == 1000 * 1000
    assert {(r.book_id_a, r.book_id_b) for r in drawn.collect()} == {("b0", "b1")} and drawn.count() == 2


def test_few_texts_are_asked_for_by_id(spark):
    asked = sampling._texts(spark.range(1000).withColumnRenamed("id", "event_id"), spark.sql("SELECT explode(array(3L, 5L, 5L)) event_id"))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and sorted(r[0] for r in asked.collect()) == [3, 5]


def test_points_of_the_cap_are_sent_before_they_get_rows_for_groups(spark, monkeypatch):
    kept = []
    real = sampling.checkpointed
    monkeypatch.setattr(sampling, "checkpointed", lambda df: kept.append(real(df)) or kept[-1])
    p = many(spark, 2000)
    assert 50 < sampling.bernoulli_pairs(p, "year", "city", cap=100).count() < 160
    # Points, groups and what was drawn; no table of all cells.
    assert sum(x.count() > 300 for x in kept) == 1
