"""Text for places and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transport_label(mode: Column) -> Column:
    return F.replace(mode, F.lit("_"), F.lit(" "))


def readable_location() -> Column:
    """From the columns of a location: most specific level first; a journey's ends and means."""
    end = lambda side: F.coalesce(f"transit_{side}_city", f"transit_{side}_country", F.lit("an unknown place"))
    means = F.coalesce(F.concat(F.lit(" by "), transport_label(F.col("transport_mode"))), F.lit(""))
    journey = F.concat(F.lit("travelling from "), end("from"), F.lit(" to "), end("to"), means)
    place = F.concat_ws(", ", "neighborhood", "city", "region", "country")
    place = F.when(place == "", "an unspecified location").otherwise(place)
    return F.when(F.col("location_type") == "transit", journey).otherwise(place)


def readable_time(pad_month: bool = True) -> Column:
    """From the time columns of an event. Null where its precision needs a part that is missing or no such day exists.

    The month's name is blank-padded to nine letters before the year, unless ``pad_month`` is false.
    """
    y, m, d = F.col("time_year"), F.col("time_month"), F.col("time_day")
    day = lambda d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    whole = lambda *c: F.expr(" AND ".join(f"{x} IS NOT NULL" for x in c))
    name = lambda x: F.rpad(F.date_format(x, "MMMM"), 9, " ") if pad_month else F.date_format(x, "MMMM")
    year = lambda x: F.date_format(x, "yyyy")
    on_day, in_month = day(d), day(F.lit(1))
    estimated = F.when(F.col("time_source") == "book_estimated", "estimated ").otherwise("")
    span = F.concat(estimated, F.col("time_year_range_start").cast("string"), F.lit("-"), F.col("time_year_range_end").cast("string"))
    kind = F.col("time_precision")
    return (
        F.when(kind == "day", F.when(whole("time_year", "time_month", "time_day"), F.concat(F.date_format(on_day, "dd "), name(on_day), F.lit(" "), year(on_day))).otherwise(None))
        .when(kind == "month", F.when(whole("time_year", "time_month"), F.concat(name(in_month), F.lit(" "), year(in_month))).otherwise(None))
        .when(kind == "year", y.cast("string"))
        .when(kind == "year_range", span)
        .otherwise("an unknown time")
    )


def place_side() -> Column:
    """What to look up on a map: nothing for fictional places, a journey's destination, else the place itself."""
    kind = F.col("location_type")
    pick = lambda journey, place: F.when(kind == "fictional", None).when(kind == "transit", journey).otherwise(place)
    return F.struct(
        pick(F.col("transit_to_country"), F.col("country")).alias("country"),
        pick(F.lit(None).cast("string"), F.col("region")).alias("region"),
        pick(F.col("transit_to_city"), F.col("city")).alias("city"),
    )
