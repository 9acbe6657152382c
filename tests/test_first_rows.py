"""First common years: pairs are made of groups of alike points and their first names."""

from pyspark.sql import functions as F

from chronotopia.operators import encounters
from tests.test_core import pts


def test_first_year_is_not_listed(spark, monkeypatch):
    """4,000 names of two books begin in one year: 4 million pairs, of which none but those of first names are made."""
    one = pts(spark, ("a", 1800, 1800, None, None, "x", None, "c", None))
    p = one.crossJoin(spark.range(4000)).withColumns({"event_id": F.col("id"), "book_id": F.concat(F.lit("b"), F.col("id") % 2)}).drop("id")
    names = p.select("event_id", F.format_string("n%05d", "event_id").alias("character_name"))
    seen, real = [], encounters._joined
    monkeypatch.setattr(encounters, "_joined", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    got = [(r.character_a, r.character_b) for r in encounters.overlap_years(p, names, "city", 5).collect()]
    assert got == [("n00000", f"n{n:05d}") for n in (1, 3, 5, 7, 9)]
    assert max(x.count() for x in seen) <= 25
