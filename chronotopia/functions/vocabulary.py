"""Enumerations and constants of the data model."""

TIME_GRANULARITIES = ("none", "century", "decade", "year", "month", "day")
LOCATION_LEVELS = ("country", "region", "city", "neighborhood")
LOCATION_GRANULARITIES = ("none", *LOCATION_LEVELS)
HIERARCHY = (*LOCATION_LEVELS, "street")
TRANSIT_FIELDS = ("transit_from_country", "transit_from_city", "transit_to_country", "transit_to_city")
TIME = ("time_year_range_start", "time_year_range_end", "time_year", "time_month", "time_day")
PLACE = ("location_type", *HIERARCHY, "proximity", *TRANSIT_FIELDS, "transport_mode", "transport_detail", "source")
MAX_CHAPTERS = 120
CANDIDATE_CAP = 20_000
EVIDENCE_HALF = 5
TOC_GAP = 500
IMPORTANCE_MARGIN = 0.05

# Names that are continents, and country names in other languages with their English form.
CONTINENTS = ("africa", "europe", "asia", "antarctica", "north america", "south america")
COUNTRY_ALIASES = (
    ("deutschland", "Germany"),
    ("belgië / belgique / belgien", "Belgium"),
    ("schweiz/suisse/svizzera/svizra", "Switzerland"),
    ("éire / ireland", "Ireland"),
    ("lëtzebuerg", "Luxembourg"),
    ("türkiye", "Turkey"),
    ("eesti", "Estonia"),
    ("italia", "Italy"),
    ("پاکستان", "Pakistan"),
    ("مصر", "Egypt"),
)
# Which kinds of address the gazetteer may answer with, by level.
ADDRESS_TYPES = {
    "country": ("country",),
    "region": ("state", "region"),
    "city": ("city", "town", "village", "municipality", "county"),
}
# Plain-text formats of the catalogue, in order of preference.
PLAIN_TEXT = ("text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain")
