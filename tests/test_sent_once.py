"""What pairs are made of is sent once, for both sides of the join and whichever levels the other side knows."""

from pyspark.sql import functions as F

from chronotopia.operators import encounters
from tests.test_supported import some


def sent(df, column):
    """Bytes that exchanges of ``column`` write, and rows, as the plan that ran says; what is reused counts once."""
    df.collect()
    found, seen = [], [df._jdf.queryExecution().executedPlan()]
    while seen:
        plan = seen.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            seen.append(plan.executedPlan())
        elif "QueryStage" in name:
            seen.append(plan.plan())
        else:
            if name == "Exchange" and column in plan.output().mkString(" "):
                found.append(plan.metrics().apply("shuffleRecordsWritten").value())
            seen += [plan.children().apply(k) for k in range(plan.children().size())]
    return found


def test_units_of_groups(spark):
    p, r = some(spark, 200)
    p = p.withColumn("y_end", F.col("y_start"))  # so each lies in one bucket
    units = encounters._units(p, r, "year", "city", None, True).count()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sent(encounters.encounters(p, r, "year", "city"), "rest") == [units]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_short_sides_are_not_grouped(spark, monkeypatch):
    """A long side has its own pairs grouped, not those of all others."""
    p, r = some(spark, 120)
    monkeypatch.setattr(encounters, "LISTED", 2)
    got = encounters.encounters(p, r, "month", "city")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    monkeypatch.setattr(encounters, "LISTED", 64)
    assert sorted(map(str, got.collect())) == sorted(map(str, encounters.encounters(p, r, "month", "city").collect()))


def test_names_of_common_years(spark):
    p, r = some(spark, 200)
    p = p.withColumn("y_end", F.col("y_start"))  # so each has one span
    r = r.withColumn("character_name", F.concat(F.lit("N"), F.col("event_id").cast("string")))
    units = p.join(r.select("event_id", "character_name"), "event_id").filter("book_id IS NOT NULL AND city IS NOT NULL")
    n = units.select("book_id", "y_start", "country", "region", "city", "character_name").distinct().count()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sent(encounters.overlap_years(p, r, "city", None), "unit#") == [n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
