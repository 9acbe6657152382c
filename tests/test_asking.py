from pyspark.sql import functions as F

from chronotopia.operators import refinement as R


def test_only_events_with_a_deeper_place_ask(spark):
    """Of one character nothing is deeper; of the other one event asks, for one set of levels and one class of dates."""
    place = "'real' location_type, 'c' country, 'r' region, {} city"
    rows = spark.sql(f"SELECT 'b' book_id, 1 character_id, 1 ordinal, 1800 y, {place.format("'x'")} UNION ALL SELECT 'b', 1, 2, 1800, {place.format("'z'")} UNION ALL SELECT 'b', 2, 1, 1800, {place.format('NULL')} UNION ALL SELECT 'b', 2, 2, NULL, {place.format("'x'")}")
    rows = rows.withColumns({c: F.lit(None).cast("int") for c in R.TIME if c != "time_year"} | {c: F.lit(None).cast("string") for c in R.PLACE if c not in rows.columns}).withColumnRenamed("y", "time_year")
    fixed = rows.withColumn("_class", R._date_class()).withColumn("_given", F.struct(*R.PLACE))
    got = {(r.character_id, r.ordinal): r for r in R._in_use(fixed).collect()}
    assert [k for k, r in got.items() if r._asks] == [(2, 1)]
    assert got[1, 1]._wanted == got[1, 1]._asking == 0
    assert bin(got[2, 2]._wanted).count("1") == 1 and got[2, 2]._asking == 1 << got[2, 1]._class and bin(got[2, 2]._offering).count("1") == 2
