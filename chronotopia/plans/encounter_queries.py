"""Registered queries over match points and encounters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.display import place_side, readable_location, readable_time, transport_label
from ..functions.predicates import UNIT
from ..functions.vocabulary import CANDIDATE_CAP, CONTINENTS, LOCATION_LEVELS
from ..operators import encounters as E
from ..operators import points as P
from ..operators import sampling as S
from ..sources.adapters import duck, view

QUERIES, ORACLES = {}, {}


def _points(spark, d):
    return P.event_match_points(view(spark, d, "presence"), view(spark, d, "locations"))


def _readable(spark, d):
    return P.event_readable(*(view(spark, d, n) for n in ("presence", "books", "characters", "locations")))


_end = lambda side: f"{{'role': '{side}', 'country': transit_{side}_country, 'region': NULL, 'city': transit_{side}_city, 'neighborhood': NULL}}"
# Each place's points as a list; of a journey the ends of which anything is known.
LOCATION_POINTS = f"""SELECT location_id, p.role AS point_role, p.country AS country, p.region AS region, p.city AS city, p.neighborhood AS neighborhood FROM (SELECT location_id, unnest(CASE
  WHEN location_type <> 'transit' THEN [{{'role': 'place', 'country': country, 'region': region, 'city': city, 'neighborhood': neighborhood}}]
  WHEN location_type = 'transit' THEN list_filter([{_end('from')}, {_end('to')}], lambda x: coalesce(x.country, x.city) IS NOT NULL) END) AS p FROM locations)"""
_folded = ", ".join(f"lower(trim({c})) AS {c}" for c in LOCATION_LEVELS)
_bounds = ", ".join(f"ifnull(time_year_range_{side}, time_year) AS y_{side}" for side in ("start", "end"))
MATCH_POINTS = f"""SELECT event_id, book_id, character_id, {_bounds}, time_month, time_day, location_id, point_role, {_folded} FROM (SELECT * FROM presence WHERE time_precision IS NOT NULL) JOIN ({LOCATION_POINTS}) USING (location_id)"""
PLACE = """CASE WHEN location_type = 'transit' THEN 'travelling from ' || coalesce(transit_from_city, transit_from_country, 'an unknown place') || ' to ' || coalesce(transit_to_city, transit_to_country, 'an unknown place')
  || coalesce(' by ' || replace(transport_mode, '_', ' '), '') ELSE coalesce(nullif(concat_ws(', ', neighborhood, city, region, country), ''), 'an unspecified location') END"""
PLAIN_TIME = """CASE time_precision WHEN 'day' THEN strftime(make_date(time_year, time_month, time_day), '%d %B %Y') WHEN 'month' THEN strftime(make_date(time_year, time_month, 1), '%B %Y')
  WHEN 'year' THEN time_year::VARCHAR WHEN 'year_range' THEN (CASE WHEN time_source = 'book_estimated' THEN 'estimated ' ELSE '' END) || time_year_range_start || '-' || time_year_range_end ELSE 'an unknown time' END"""
TIME = """CASE time_precision WHEN 'day' THEN strftime(make_date(time_year, time_month, time_day), '%d ') || rpad(strftime(make_date(time_year, time_month, time_day), '%B'), 9, ' ') || strftime(make_date(time_year, time_month, time_day), ' %Y') WHEN 'month' THEN rpad(strftime(make_date(time_year, time_month, 1), '%B'), 9, ' ') || strftime(make_date(time_year, time_month, 1), ' %Y')
  WHEN 'year' THEN time_year::VARCHAR WHEN 'year_range' THEN (CASE WHEN time_source = 'book_estimated' THEN 'estimated ' ELSE '' END) || time_year_range_start || '-' || time_year_range_end ELSE 'an unknown time' END"""
READABLE = f"""SELECT e.event_id, e.book_id, b.title AS book_title, c.canonical_name AS character_name, {PLACE} AS readable_location, {TIME} AS readable_time, evidence_quote, location_type, country, region, city, transit_to_country, transit_to_city
  FROM presence e JOIN books b ON b.book_id = e.book_id JOIN characters c ON c.book_id = e.book_id AND c.character_id = e.character_id JOIN locations l ON l.location_id = e.location_id"""
ALL = "books characters locations presence"


def time_sql(g: str) -> str:
    if g == "none":
        return "true"
    n = UNIT[g]
    at = lambda s, c: f"{s}.{c}" if n == 1 else f"floor({s}.{c} / {n}.0)"
    cond = f"{at('a', 'y_start')} <= {at('b', 'y_end')} AND {at('b', 'y_start')} <= {at('a', 'y_end')}"
    for c in {"month": ("time_month",), "day": ("time_month", "time_day")}.get(g, ()):
        cond += f" AND (a.{c} IS NULL OR b.{c} IS NULL OR a.{c} = b.{c})"
    return cond


def location_sql(g: str) -> str:
    if g == "none":
        return "true"
    coarser = LOCATION_LEVELS[: LOCATION_LEVELS.index(g)]
    return f"a.{g} = b.{g}" + "".join(f" AND (a.{c} IS NULL OR b.{c} IS NULL OR a.{c} = b.{c})" for c in coarser)


def pairs_sql(time: str, location: str, what: str, more: str = "") -> str:
    return duck("locations presence", f"SELECT {what} FROM ({MATCH_POINTS}) a JOIN ({MATCH_POINTS}) b ON a.book_id < b.book_id AND {time_sql(time)} AND {location_sql(location)} {more}")


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_add("location_points", lambda s, d: P.location_points(view(s, d, "locations")).drop("book_id"), duck("locations", LOCATION_POINTS))
_add("event_match_points", _points, duck("locations presence", MATCH_POINTS))
_add("event_readable", _readable, duck(ALL, READABLE))
_add("readable_location", lambda s, d: view(s, d, "locations").select("location_id", readable_location().alias("readable_location")), duck("locations", f"SELECT location_id, {PLACE} AS readable_location FROM locations"))
_add("readable_time", lambda s, d: view(s, d, "presence").select("event_id", readable_time().alias("readable_time")), duck("presence", f"SELECT event_id, {TIME} AS readable_time FROM presence"))
_add("readable_time_plain", lambda s, d: view(s, d, "presence").select("event_id", readable_time(False).alias("readable_time")), duck("presence", f"SELECT event_id, {PLAIN_TIME} AS readable_time FROM presence"))
_add("transport_label", lambda s, d: view(s, d, "locations").filter("transport_mode IS NOT NULL").select("location_id", transport_label(F.col("transport_mode")).alias("label")),
     duck("locations", "SELECT location_id, replace(transport_mode, '_', ' ') AS label FROM locations WHERE transport_mode IS NOT NULL"))
_add("api_place_side", lambda s, d: view(s, d, "locations").select("location_id", place_side().alias("p")).select("location_id", "p.*"),
     duck("locations", """SELECT location_id, CASE location_type WHEN 'fictional' THEN NULL WHEN 'transit' THEN transit_to_country ELSE country END AS country,
  CASE WHEN location_type IN ('fictional', 'transit') THEN NULL ELSE region END AS region, CASE location_type WHEN 'fictional' THEN NULL WHEN 'transit' THEN transit_to_city ELSE city END AS city FROM locations"""))  # fmt: skip

for _t in ("none", "century", "decade", "year", "month", "day"):
    for _l in ("none", *LOCATION_LEVELS):
        _name = f"time_{_t}_loc_{_l}_count"
        _sql = pairs_sql(_t, _l, "count(*) AS n")
        _add(_name, lambda s, d, t=_t, l=_l: E.pair_count(_points(s, d), t, l), _sql)

_ids = ", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in ("event_id", "book_id", "character_id", "location_id", "point_role"))
_add("pairs_city_year", lambda s, d: E.pairs(_points(s, d), "year", "city"), pairs_sql("year", "city", _ids))
_add("pairs_neighborhood_day", lambda s, d: E.pairs(_points(s, d), "day", "neighborhood"), pairs_sql("day", "neighborhood", _ids))
_add("country_filter", lambda s, d: E.pair_count(_points(s, d), "year", "city", " Nation_3 "), pairs_sql("year", "city", "count(*) AS n", "WHERE a.country = 'nation_3' AND b.country = 'nation_3'"))
_add("list_countries", lambda s, d: E.list_countries(_points(s, d)),
     pairs_sql("none", "country", "DISTINCT a.country", "WHERE a.country NOT IN (" + ", ".join(f"'{c}'" for c in CONTINENTS) + ")"))


def groups_sql(time: str, location: str) -> str:
    side = lambda s: ", ".join(f"r{s}.{c} AS {n}_{s}" for c, n in zip(E.SIDE, E.NAMES))
    key = "character_id_a, character_id_b, location_a, time_a, location_b, time_b"
    body = f""", pts AS ({MATCH_POINTS}), readable AS ({READABLE}), found AS (SELECT {_ids} FROM pts a JOIN pts b ON a.book_id < b.book_id AND {time_sql(time)} AND {location_sql(location)}),
  shown AS (SELECT character_id_a, character_id_b, event_id_a, event_id_b, point_role_a, point_role_b, {side('a')}, {side('b')} FROM found JOIN readable ra ON ra.event_id = event_id_a JOIN readable rb ON rb.event_id = event_id_b)
SELECT character_id_a, character_id_b, event_id_a, event_id_b, {', '.join(f'{n}_{s}' for s in 'ab' for n in E.NAMES)}, support_count FROM
  (SELECT *, count(*) OVER (PARTITION BY {key}) AS support_count, row_number() OVER (PARTITION BY {key} ORDER BY event_id_a, event_id_b, point_role_a, point_role_b) AS rn FROM shown) WHERE rn = 1"""
    return duck(ALL, "").rstrip() + body


def _groups(time, location):
    return lambda s, d: E.encounters(_points(s, d), _readable(s, d), time, location)


_add("encounter_groups", _groups("year", "city"), groups_sql("year", "city"))
_add("encounter_examples_1", lambda s, d: E.most_supported(_points(s, d), _readable(s, d), "year", "city", limit=25), groups_sql("year", "city") + " ORDER BY support_count DESC, event_id_a, event_id_b LIMIT 25")
_add("encounter_examples_2", lambda s, d: E.most_supported(_points(s, d), _readable(s, d), "decade", "country", "NATION_3 ", 25),
     groups_sql("decade", "country").replace("FROM pts a JOIN pts b", "FROM (SELECT * FROM pts WHERE country = 'nation_3') a JOIN (SELECT * FROM pts WHERE country = 'nation_3') b") + " ORDER BY support_count DESC, event_id_a, event_id_b LIMIT 25")
_add("encounter_examples_3", lambda s, d: E.most_supported(_points(s, d), _readable(s, d), "month", "neighborhood", limit=25), groups_sql("month", "neighborhood") + " ORDER BY support_count DESC, event_id_a, event_id_b LIMIT 25")
_overlap = f""", pts AS ({MATCH_POINTS}), readable AS ({READABLE}) SELECT DISTINCT ra.character_name AS character_a, rb.character_name AS character_b, a.city AS place,
  CASE WHEN greatest(a.y_start, b.y_start) <= least(a.y_end, b.y_end) THEN greatest(a.y_start, b.y_start) END AS overlap_start, CASE WHEN greatest(a.y_start, b.y_start) <= least(a.y_end, b.y_end) THEN least(a.y_end, b.y_end) END AS overlap_end
  FROM pts a JOIN pts b ON a.book_id < b.book_id AND {time_sql('year')} AND {location_sql('city')} JOIN readable ra ON ra.event_id = a.event_id JOIN readable rb ON rb.event_id = b.event_id"""
_add("overlap_years", lambda s, d: E.overlap_years(_points(s, d), _readable(s, d), "city", None), duck(ALL, "").rstrip() + _overlap)
_add("sort_limit", lambda s, d: E.overlap_years(_points(s, d), _readable(s, d), "city", 20), duck(ALL, "").rstrip() + _overlap + " ORDER BY overlap_start NULLS LAST, overlap_end NULLS LAST, character_a, character_b, place LIMIT 20")
_add("same_book_check", lambda s, d: E.same_book_check(_points(s, d), view(s, d, "books")),
     duck(ALL, "").rstrip() + f", pts AS ({MATCH_POINTS}) SELECT count(*) AS total, count(*) FILTER (WHERE ba.title = bb.title) AS same_book FROM pts a JOIN pts b ON a.book_id < b.book_id AND {time_sql('year')} AND {location_sql('city')} JOIN books ba ON ba.book_id = a.book_id JOIN books bb ON bb.book_id = b.book_id")


def number_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, {S.DIGITS}))::BIGINT"


def sides_sql(time: str, location: str) -> str:
    """CTEs up to e: the rows of sampling.sides."""
    wild, place = E._wild(time, location), "" if location == "none" else location
    units = "0 AS u_start, 0 AS u_end, 0 AS unit"
    if time != "none":
        at = lambda c: c if UNIT[time] == 1 else f"floor({c} / {UNIT[time]}.0)::INT"
        units = f"{at('y_start')} AS u_start, {at('y_end')} AS u_end, unnest(range(least({at('y_start')}, {at('y_end')}), greatest({at('y_start')}, {at('y_end')}) + 1))::INT AS unit"
    known = " AND ".join(["book_id IS NOT NULL", *([f"{place} IS NOT NULL"] if place else []), *(["y_start IS NOT NULL", "y_end IS NOT NULL"] if time != "none" else [])])
    own, bits = " + ".join([f"(CASE WHEN {c} IS NOT NULL THEN {1 << k} ELSE 0 END)" for k, c in enumerate(wild)] or ["0"]), 1 << len(wild)
    shared = "".join(f", coalesce(CASE WHEN own & other & {1 << k} <> 0 THEN {c} END::VARCHAR, '')" for k, c in enumerate(wild))
    return f"""pts AS ({MATCH_POINTS}), spread AS (SELECT *, {units}, md5(concat_ws('|', event_id, point_role)) AS d, {own} AS own FROM pts WHERE {known}),
  e AS (SELECT *, substr(d, 1, 2) AS bin, md5(concat_ws('|', {f"{place}, " if place else ""}unit, CASE WHEN second THEN other * {bits} + own ELSE own * {bits} + other END{shared})) AS g
    FROM (SELECT *, unnest([false, true]) AS second FROM (SELECT *, unnest(range({bits})) AS other FROM spread)))"""


_agree = "a.unit = greatest(a.u_start, b.u_start) AND a.u_start <= b.u_end AND b.u_start <= a.u_end"
_side = lambda s: ", ".join(f"r{s}.{c} AS {n}_{s}" for c, n in zip(E.SIDE, E.NAMES))
_in_order = "a.d, a.event_id, a.point_role, b.book_id, b.d, b.event_id, b.point_role"


def possible_sql(time: str) -> str:
    """CTE all_pairs: every possible pair with its number in all (t) and in its cell (pos), and if it counts."""
    return f"""all_pairs AS (SELECT {_ids}, a.g AS g, a.bin AS bin, {'true' if time == 'none' else _agree} AS counts, row_number() OVER (ORDER BY a.g, a.book_id, {_in_order}) - 1 AS t,
    row_number() OVER (PARTITION BY a.g, a.book_id, a.bin ORDER BY {_in_order}) - 1 AS pos FROM e a JOIN e b ON a.g = b.g AND a.book_id < b.book_id AND NOT a.second AND b.second)"""


def capped_sql(time: str, location: str, seed: int) -> str:
    u = lambda k: f"floor(ln(({number_sql(repr(str(seed)), 'g', 'book_id_a', 'bin', k)} + 0.5::DOUBLE) / {S.WHOLE}) / pace)::BIGINT"
    cell = "g, book_id_a, bin, weight"
    return f""", {sides_sql(time, location)}, {possible_sql(time)}, n AS (SELECT count(*) AS n FROM all_pairs WHERE counts), rate AS (SELECT ln(1 - {CANDIDATE_CAP} / n::DOUBLE) AS pace FROM n WHERE n > {CANDIDATE_CAP}),
  steps AS (SELECT {cell}, 0 AS k, {u("'0'")} AS pos FROM (SELECT g, book_id_a, bin, count(*) AS weight FROM all_pairs GROUP BY ALL), rate UNION ALL SELECT {cell}, k + 1, pos + 1 + {u('k + 1')} FROM steps, rate WHERE pos < weight)
SELECT * EXCLUDE (g, bin, counts, t, pos) FROM all_pairs WHERE counts AND ((SELECT n FROM n) <= {CANDIDATE_CAP} OR (g, book_id_a, bin, pos) IN (SELECT (g, book_id_a, bin, pos) FROM steps))"""


_shown_cols = f"character_id_a, character_id_b, event_id_a, event_id_b, {', '.join(f'{n}_{s}' for s in 'ab' for n in E.NAMES)}, support_count"
_alike = "book_id_a, character_id_a, location_a, time_a, book_id_b, character_id_b, location_b, time_b"
_taken = lambda seed: f"{number_sql(repr(f'{seed}|take'), 'draw')} / {S.WHOLE}::DOUBLE * support_count < 1 ORDER BY draw LIMIT 1"


def random_sql(time: str, location: str, seed: int) -> str:
    """By listing all pairs and the encounters they make."""
    return f""", {sides_sql(time, location)}, {possible_sql(time)}, readable AS ({READABLE}),
  shown AS (SELECT found.*, {_side('a')}, {_side('b')} FROM all_pairs found JOIN readable ra ON ra.event_id = event_id_a JOIN readable rb ON rb.event_id = event_id_b WHERE counts),
  met AS (SELECT *, count(*) OVER (PARTITION BY {_alike}) AS support_count FROM shown),
  draws AS (SELECT draw, {number_sql(repr(str(seed)), 'draw')}::HUGEINT * (SELECT count(*) FROM all_pairs) // {S.WHOLE} AS t FROM range(4096) r(draw))
SELECT {_shown_cols} FROM draws JOIN met USING (t) WHERE {_taken(seed)}"""


def random_anywhere_sql(seed: int) -> str:
    """Without any restriction there are too many pairs to list: a draw's first point is where the sums of partners pass it, its second one is counted from there."""
    return f""", {sides_sql('none', 'none')}, readable AS ({READABLE}),
  ranked AS (SELECT *, row_number() OVER (ORDER BY book_id, d, event_id, point_role) - 1 AS k, count(*) OVER (ORDER BY book_id) AS past, count(*) OVER () AS n FROM e WHERE second),
  firsts AS (SELECT *, coalesce(sum(n - past) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ranked),
  draws AS (SELECT draw, {number_sql(repr(str(seed)), 'draw')}::HUGEINT * (SELECT sum(n - past) FROM firsts) // {S.WHOLE} AS t FROM range(64) r(draw)),
  drawn AS (SELECT draw, a.event_id AS event_id_a, b.event_id AS event_id_b, a.book_id AS book_id_a, b.book_id AS book_id_b, a.character_id AS character_id_a, b.character_id AS character_id_b
    FROM draws JOIN firsts a ON t >= start AND t < start + n - past JOIN ranked b ON b.k = a.past + (t - start)),
  shown AS (SELECT drawn.*, {_side('a')}, {_side('b')} FROM drawn JOIN readable ra ON ra.event_id = event_id_a JOIN readable rb ON rb.event_id = event_id_b),
  alike AS (SELECT s.draw, p.event_id, p.book_id = s.book_id_a AS first FROM shown s JOIN ranked p ON (p.book_id = s.book_id_a AND p.character_id = s.character_id_a) OR (p.book_id = s.book_id_b AND p.character_id = s.character_id_b)
    JOIN readable r ON r.event_id = p.event_id WHERE r.readable_location = CASE WHEN p.book_id = s.book_id_a THEN location_a ELSE location_b END AND r.readable_time IS NOT DISTINCT FROM CASE WHEN p.book_id = s.book_id_a THEN time_a ELSE time_b END),
  met AS (SELECT shown.*, x.support_count FROM shown JOIN (SELECT draw, count(*) FILTER (WHERE first) * count(*) FILTER (WHERE NOT first) AS support_count FROM alike GROUP BY draw) x USING (draw))
SELECT {_shown_cols} FROM met WHERE {_taken(seed)}"""


_with_recursive = lambda names: duck(names, "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
_add("bernoulli_cap", lambda s, d: S.bernoulli_pairs(_points(s, d), "year", "city", seed=1), _with_recursive("locations presence") + capped_sql("year", "city", 1))
_add("random_encounter", lambda s, d: S.random_encounter(_points(s, d), _readable(s, d), "year", "city", seed=3), duck(ALL, "").rstrip() + random_sql("year", "city", 3))
_add("random_encounter_decade_region", lambda s, d: S.random_encounter(_points(s, d), _readable(s, d), "decade", "region", seed=5), duck(ALL, "").rstrip() + random_sql("decade", "region", 5))
_add("random_encounter_anywhere", lambda s, d: S.random_encounter(_points(s, d), _readable(s, d), "none", "none", seed=4), duck(ALL, "").rstrip() + random_anywhere_sql(4))
_add("fk_joins", lambda s, d: _readable(s, d).groupBy("book_title").agg(F.count("*").alias("n")), duck(ALL, f"SELECT book_title, count(*) AS n FROM ({READABLE}) GROUP BY book_title"))
