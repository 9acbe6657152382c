"""Registered queries over text, registries, cleanup, places, people, ranking and the store."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.vocabulary import COUNTRY_ALIASES, HIERARCHY, TRANSIT_FIELDS
from ..operators import cleanup, fold, people, places, ranking, text
from ..sources import adapters, catalog, store
from ..sources.adapters import duck, read, view

QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# Text: conversations as novels, their turns as chapters.
def _novels(s, d, contents=False):
    turns = read(s, d, "conversations").filter("text IS NOT NULL")
    body = F.concat(F.lit("CHAPTER "), (F.col("turn") + 1).cast("string"), F.lit("\n\n"), F.col("text"))
    packed = turns.groupBy(F.col("conv_id").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))).alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["b"]), "\n\n")
    toc = F.array_join(F.transform("c", lambda x: F.concat(F.lit("CHAPTER "), (x["turn"] + 1).cast("string"))), "\n\n")
    return packed.select("book_id", (F.concat(toc, F.lit("\n\n"), whole) if contents else whole).alias("text"))


def _chapters(s, d):
    return text.split_chapters(_novels(s, d))


_PARAS = "list_filter(list_transform(regexp_split_to_array({t}, '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')"
_CHAPTERS = f"""SELECT conv_id AS book_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS chapter, 'CHAPTER ' || (turn + 1) AS title, {_PARAS.format(t='text')} AS paragraphs
  FROM conversations WHERE text IS NOT NULL AND len({_PARAS.format(t='text')}) > 0"""
_marked = lambda: F.concat(F.lit("head *** START OF THE PROJECT GUTENBERG EBOOK x ***\n "), F.col("text"), F.lit(" \n*** END OF THE PROJECT GUTENBERG EBOOK x *** tail"))
_add("strip_boilerplate", lambda s, d: read(s, d, "documents").select("doc_id", text.strip_boilerplate(_marked()).alias("body")),
     "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents")
_add("split_paragraphs", lambda s, d: read(s, d, "documents").select("doc_id", F.to_json(text.split_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")))).alias("paragraphs")),
     f"SELECT doc_id, CAST(to_json({_PARAS.format(t=chr(39).join(['replace(text, chr(10), chr(10) || ', ' ', ' || chr(10))']))}) AS VARCHAR) AS paragraphs FROM documents")
_add("find_headings", lambda s, d: text.find_headings(_novels(s, d)).select("book_id", "position", "title", "number"),
     "SELECT conv_id AS book_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position, 'CHAPTER ' || (turn + 1) AS title, (turn + 1)::VARCHAR AS number FROM conversations WHERE text IS NOT NULL")
_add("drop_toc", lambda s, d: text.drop_toc(_novels(s, d, True)), "SELECT conv_id AS book_id, (2 * count(*))::INT AS headings, count(*)::INT AS dropped FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
_add("split_chapters", lambda s, d: _chapters(s, d).select("book_id", "chapter", "title", F.size("paragraphs").alias("n")), f"SELECT book_id, chapter, title, len(paragraphs)::INT AS n FROM ({_CHAPTERS})")
_add("chapter_text", lambda s, d: _chapters(s, d).select("book_id", "chapter", F.md5(text.chapter_text(F.col("paragraphs")).cast("binary")).alias("digest")),
     f"SELECT book_id, chapter, md5(array_to_string(paragraphs, chr(10) || chr(10))) AS digest FROM ({_CHAPTERS})")
_add("chapter_sample", lambda s, d: text.chapter_sample(_chapters(s, d), 50).select("book_id", "chapter"),
     f"SELECT book_id, chapter FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM ({_CHAPTERS})) WHERE chapter <= greatest(1, round_even(n * 50.0 / 100, 0))")
_add("setting_sample", lambda s, d: text.setting_sample(_chapters(s, d)).select("book_id", F.md5(F.col("opening").cast("binary")).alias("digest")),
     f"SELECT book_id, md5(string_agg(array_to_string(paragraphs, chr(10) || chr(10)), chr(10) || chr(10) ORDER BY chapter)) AS digest FROM ({_CHAPTERS}) WHERE chapter <= 2 GROUP BY book_id")
_add("slugify", lambda s, d: read(s, d, "part").select("p_partkey", fold.slugify(F.concat("p_name", F.lit("--"), "p_brand", F.lit("!"))).alias("slug")),
     "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || '--' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'character') AS slug FROM part")

# Catalogue: parts as books.
_k = lambda: F.col("p_partkey")


def _formats():
    url = lambda x: F.concat(F.lit(x), _k().cast("string"))
    pairs = (("text/plain; charset=utf-8", 2), ("text/plain; charset=us-ascii", 3), ("text/plain", 5), ("text/plain; charset=latin1", 7), ("text/html", 1))
    return F.map_from_entries(F.filter(F.array(*[F.when(_k() % n == 0, F.struct(F.lit(m).alias("key"), url(f"u{n}/").alias("value"))) for m, n in pairs]), lambda e: e.isNotNull()))


_add("pick_format_url", lambda s, d: read(s, d, "part").select("p_partkey", catalog.pick_format_url(_formats()).alias("url")),
     "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'u2/' WHEN p_partkey % 3 = 0 THEN 'u3/' WHEN p_partkey % 5 = 0 THEN 'u5/' WHEN p_partkey % 7 = 0 THEN 'u7/' END || p_partkey AS url FROM part")


def _catalog(s, d):
    author = lambda n: F.struct(n.alias("name"), (F.lit(1700) + _k() % 200).cast("int").alias("birth_year"), F.when(_k() % 3 != 0, (F.lit(1760) + _k() % 200).cast("int")).alias("death_year"))
    none = F.array().cast("array<struct<name:string,birth_year:int,death_year:int>>")
    authors = F.when(_k() % 4 == 0, none).when(_k() % 4 == 1, F.array(author(F.col("p_brand")))).otherwise(F.array(author(F.col("p_brand")), author(F.col("p_type"))))
    langs = F.when(_k() % 5 == 0, F.array().cast("array<string>")).when(_k() % 5 == 1, F.array(F.lit("fr"), F.lit("en"))).when(_k() % 5 == 2, F.array(F.lit("de"))).otherwise(F.array(F.lit("en")))
    return read(s, d, "part").select(_k().alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("request"), F.lit("Asked").alias("asked_author"), authors.alias("authors"), langs.alias("languages"),
                                     F.when(_k() % 6 != 0, F.col("p_size")).alias("download_count"), _k().alias("position"))


_LANG = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 2 THEN 'de' ELSE 'en' END"
_add("novel_metadata", lambda s, d: catalog.novel_metadata(_catalog(s, d)),
     f"""SELECT p_partkey AS id, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'Asked' WHEN 1 THEN p_brand ELSE p_brand || ', ' || p_type END AS author, {_LANG} AS language,
  CASE WHEN p_partkey % 6 <> 0 THEN p_size END AS download_count, CASE WHEN p_partkey % 4 <> 0 THEN (1700 + p_partkey % 200)::INT END AS author_birth_year,
  CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN (1760 + p_partkey % 200)::INT END AS author_death_year FROM part""")  # fmt: skip
_add("pick_best_edition", lambda s, d: catalog.pick_best_edition(_catalog(s, d)).select("request", "id"),
     f"SELECT request, id FROM (SELECT p_brand AS request, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN ({_LANG}) = 'en' THEN 0 ELSE 1 END, CASE WHEN p_partkey % 6 <> 0 THEN p_size ELSE 0 END DESC, p_partkey) AS n FROM part) WHERE n = 1")
_add("catalog_search", lambda s, d: catalog.search(_catalog(s, d), "red", "brand#1").select("id"), "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_brand || ' ' || p_type END), 'red') AND contains(lower(p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_brand || ' ' || p_type END), 'brand#1')")
_add("catalog_get", lambda s, d: catalog.get(_catalog(s, d), 7).select("id", "title"), "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey = 7")
_add("json_extract", lambda s, d: read(s, d, "events").select("event_id", catalog.json_extract(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done")))
     .when(F.col("event_id") % 4 == 2, F.lit("no json {")).otherwise(F.col("props"))).alias("answer")), "SELECT event_id, CASE WHEN event_id % 4 <> 2 THEN props END AS answer FROM events")


# Registries: a customer's orders are declarations, the month is the chapter.
def _declared(s, d):
    e = view(s, d, "presence").filter("event_id % 3 <> 0")
    return e.select("book_id", F.col("character_id").cast("string").alias("id"), "chapter", F.lit(0).alias("kind"), F.col("event_id").alias("ordinal"), F.concat(F.lit("Name "), F.col("event_id").cast("string")).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))


def _used(s, d):
    return view(s, d, "presence").select("book_id", F.col("character_id").cast("string").alias("character_id"), "chapter", F.col("event_id").alias("ordinal"))


_DECLARED = "SELECT book_id, character_id::VARCHAR AS id, chapter, 0 AS kind, event_id AS ordinal, 'Name ' || event_id AS canonical_name FROM presence WHERE event_id % 3 <> 0"
_ORPHANS = f"""SELECT book_id, chapter, 1 AS kind, ordinal, id, 'Unknown (' || id || ')' AS canonical_name FROM (SELECT u.*, row_number() OVER (PARTITION BY u.book_id, u.id ORDER BY u.chapter, u.ordinal) AS n
  FROM (SELECT book_id, character_id::VARCHAR AS id, chapter, event_id AS ordinal FROM presence) u) x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM ({_DECLARED}) c WHERE c.book_id = x.book_id AND c.id = x.id AND c.chapter <= x.chapter)"""
_add("orphan_placeholders", lambda s, d: fold.orphan_placeholders(_declared(s, d), _used(s, d)).drop("aliases"), duck("presence", _ORPHANS))
_add("merge_registry", lambda s, d: fold.merge_registry(_declared(s, d).unionByName(fold.orphan_placeholders(_declared(s, d), _used(s, d)))).drop("aliases"),
     duck("presence", f"SELECT DISTINCT ON (book_id, id) book_id, id, chapter, kind, ordinal, canonical_name FROM ({_DECLARED} UNION ALL SELECT book_id, id, chapter, kind, ordinal, canonical_name FROM ({_ORPHANS})) ORDER BY book_id, id, chapter, kind, ordinal"))
_add("filter_targets", lambda s, d: fold.filter_targets(_used(s, d), _used(s, d).filter("character_id LIKE '%7'").select("book_id", F.col("character_id").alias("id"))),
     duck("presence", "SELECT book_id, character_id::VARCHAR AS character_id, chapter, event_id AS ordinal FROM presence WHERE character_id::VARCHAR LIKE '%7'"))
_add("stamp_events", lambda s, d: fold.stamp_events(_used(s, d)).select("event_id", "book_id", "chapter", "narration_order", "story_chronological_order"),
     duck("presence", "SELECT concat_ws('_', book_id, chapter, character_id, n) AS event_id, book_id, chapter, n AS narration_order, NULL::INT AS story_chronological_order FROM (SELECT *, (row_number() OVER (PARTITION BY book_id, chapter ORDER BY event_id))::INT AS n FROM presence)"))
_add("seed_characters", lambda s, d: fold.seed_characters(view(s, d, "characters").select("book_id", F.col("canonical_name").alias("name"), F.col("character_id").alias("ordinal"))).select("book_id", "chapter", "ordinal", "id", "canonical_name"),
     duck("characters", "SELECT book_id, 0 AS chapter, character_id AS ordinal, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '_', 'g'), '_') AS id, canonical_name FROM characters"))


def _answers(s, d):
    k = F.col("event_id")
    q = lambda v: F.concat(F.lit('"c'), v.cast("string"), F.lit('"'))
    whole = F.concat(F.lit('{"id": '), q(k), F.lit(', "canonical_name": "N", "aliases": ["x", "y"]}'))
    json = F.when(k % 3 == 0, q(k)).when(k % 3 == 1, F.concat(F.lit("["), q(k), F.lit(", "), whole, F.lit("]"))).otherwise(F.lit("not json"))
    return view(s, d, "presence").select("book_id", "chapter", json.alias("new_characters"))


_add("normalize_new_characters", lambda s, d: fold.normalize_new_characters(_answers(s, d)).select("book_id", "chapter", "ordinal", "id", "canonical_name", F.size("aliases").alias("n")),
     duck("presence", """SELECT book_id, chapter, o::INT AS ordinal, 'c' || event_id AS id, CASE o WHEN 0 THEN 'c' || event_id ELSE 'N' END AS canonical_name, CASE o WHEN 0 THEN 0 ELSE 2 END AS n FROM presence, (VALUES (0), (1)) t(o) WHERE event_id % 3 = 1"""))
_add("prompt_state", lambda s, d: fold.prompt_state(view(s, d, "characters").select("book_id", F.col("character_id").alias("id"), "canonical_name", F.array().cast("array<string>").alias("aliases")), view(s, d, "locations").filter("city IS NOT NULL").select("book_id", F.col("location_id").alias("id"), F.col("city").alias("canonical_name")))
     .select("book_id", F.md5(F.col("state").cast("binary")).alias("digest")),
     duck("characters locations", """SELECT book_id, md5(to_json({'characters': c, 'locations': l})::VARCHAR) AS digest FROM
  (SELECT book_id, list({'id': character_id, 'canonical_name': canonical_name, 'aliases': []::VARCHAR[]} ORDER BY character_id) AS c FROM characters GROUP BY book_id) FULL JOIN
  (SELECT book_id, list({'id': location_id, 'canonical_name': city} ORDER BY location_id) AS l FROM locations WHERE city IS NOT NULL GROUP BY book_id) USING (book_id)"""))  # fmt: skip


# Cleanup: presence with its place's columns.
def _full(s, d):
    e, l = view(s, d, "presence"), view(s, d, "locations").drop("book_id", "geocode_status")
    return e.join(l, "location_id").withColumn("transport_detail", F.lit(None).cast("string")).withColumn("ordinal", F.col("event_id"))


_FULL = "SELECT e.*, location_type, country, region, city, neighborhood, street, proximity, transit_from_country, transit_from_city, transit_to_country, transit_to_city, transport_mode, source FROM presence e JOIN locations l ON l.location_id = e.location_id"
_LOC = "(country IS NOT NULL OR region IS NOT NULL OR city IS NOT NULL OR neighborhood IS NOT NULL OR street IS NOT NULL OR (location_type = 'transit' AND (" + " OR ".join(f"{c} IS NOT NULL" for c in TRANSIT_FIELDS) + ")))"
_DATE = "(time_year IS NOT NULL OR time_year_range_start IS NOT NULL OR time_year_range_end IS NOT NULL)"
_both = "presence locations"
_add("has_usable_location", lambda s, d: _full(s, d).select("event_id", cleanup.has_usable_location().alias("usable")), duck(_both, f"SELECT event_id, {_LOC} AS usable FROM ({_FULL})"))
_add("has_usable_date", lambda s, d: view(s, d, "presence").select("event_id", cleanup.has_usable_date().alias("usable")), duck("presence", f"SELECT event_id, {_DATE} AS usable FROM presence"))
_add("dated_events", lambda s, d: cleanup.dated_events(view(s, d, "presence")).select("event_id"), duck("presence", f"SELECT event_id FROM presence WHERE {_DATE} OR time_month IS NOT NULL OR time_day IS NOT NULL"))
_TCOLS = ("time_year_range_start", "time_year_range_end", "time_year", "time_month", "time_day", "time_precision", "time_source")
_NEW = dict(zip(_TCOLS, ("x.year_range_start", "x.year_range_end", "NULL", "NULL", "NULL", "'year_range'", "'book_estimated'")))
_add("filter_complete_events", lambda s, d: cleanup.filter_complete_events(_full(s, d), view(s, d, "estimates")).select("event_id", *_TCOLS),
     duck("presence locations estimates", f"SELECT event_id, {', '.join(f'CASE WHEN {_DATE} THEN {c} ELSE {_NEW[c]} END AS {c}' for c in _TCOLS)} FROM ({_FULL}) e LEFT JOIN estimates x ON x.book_id = e.book_id AND setting_confidence IN ('medium', 'high') WHERE {_LOC} AND ({_DATE} OR x.book_id IS NOT NULL)"))


def _assigned(s, d):
    e = view(s, d, "presence").filter("event_id % 2 = 0")
    row = lambda k: e.select("event_id", F.lit(k).alias("position"), (F.col("event_id") % 1000 + k).cast("int").alias("story_chronological_order"), F.lit("certain").alias("ordering_confidence"))
    return row(0).union(row(1).filter("event_id % 4 = 0"))


_add("merge_chronology", lambda s, d: cleanup.merge_chronology(view(s, d, "presence").select("event_id"), _assigned(s, d)),
     duck("presence", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 1000 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END)::INT END AS story_chronological_order, CASE WHEN event_id % 2 = 0 THEN 'certain' END AS ordering_confidence FROM presence"))
_add("rule_chronology", lambda s, d: cleanup.rule_chronology(view(s, d, "presence")),
     duck("presence", f"""SELECT event_id, (row_number() OVER (PARTITION BY book_id ORDER BY coalesce(time_year, time_year_range_start, time_year_range_end) NULLS LAST, time_month NULLS LAST, time_day NULLS LAST,
  CASE temporal_relation WHEN 'flashback' THEN 0 WHEN 'flash_forward' THEN 2 ELSE 1 END, chapter, narration_order, event_id))::INT AS story_chronological_order FROM presence WHERE {_DATE} OR time_month IS NOT NULL OR time_day IS NOT NULL"""))  # fmt: skip

# Places.
_DEPTH = "CASE WHEN {p}street IS NOT NULL THEN 4 WHEN {p}neighborhood IS NOT NULL THEN 3 WHEN {p}city IS NOT NULL THEN 2 WHEN {p}region IS NOT NULL THEN 1 WHEN {p}country IS NOT NULL THEN 0 ELSE -1 END"
_FILLED = " + ".join("({p}" + c + " IS NOT NULL)::INT" for c in HIERARCHY)
_NESTS = "a.location_type <> 'transit' AND b.location_type <> 'transit' AND " + " AND ".join(f"(a.{c} IS NULL OR a.{c} IS NOT DISTINCT FROM b.{c})" for c in HIERARCHY) + f" AND {_DEPTH.format(p='b.')} > {_DEPTH.format(p='a.')}"


def _range_sql(p, q):
    r = lambda x: f"({x}.time_year_range_start IS NOT NULL OR {x}.time_year_range_end IS NOT NULL)"
    return f"NOT ({r(p)} AND NOT {r(q)} AND (coalesce({q}.time_year < {p}.time_year_range_start, false) OR coalesce({q}.time_year > {p}.time_year_range_end, false)))"


_COMPATIBLE = " AND ".join([f"(a.{c} IS NULL OR b.{c} IS NULL OR a.{c} = b.{c})" for c in ("time_year", "time_month", "time_day")] + [_range_sql("a", "b"), _range_sql("b", "a")])


def _self_pairs(s, d):
    e = _full(s, d)
    on = (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.character_id") == F.col("b.character_id")) & (F.col("a.event_id") != F.col("b.event_id"))
    return e.alias("a").join(e.alias("b"), on)


_PAIRS = f"FROM ({_FULL}) a JOIN ({_FULL}) b ON a.book_id = b.book_id AND a.character_id = b.character_id AND a.event_id <> b.event_id"
_add("nests_inside", lambda s, d: _self_pairs(s, d).filter(places.nests_inside()).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b")), duck(_both, f"SELECT a.event_id AS a, b.event_id AS b {_PAIRS} WHERE {_NESTS}"))
_add("time_compatible", lambda s, d: _self_pairs(s, d).filter(places.time_compatible()).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b")), duck(_both, f"SELECT a.event_id AS a, b.event_id AS b {_PAIRS} WHERE {_COMPATIBLE}"))
_add("refine_locations", lambda s, d: places.refine_locations(_full(s, d)).select("event_id", "location_type", *HIERARCHY, "proximity", "source"),
     duck(_both, f"""SELECT e.event_id, {', '.join(f'CASE WHEN m.event_id IS NULL THEN e.{c} ELSE m.{c} END AS {c}' for c in ('location_type', *HIERARCHY, 'proximity', 'source'))} FROM ({_FULL}) e LEFT JOIN
  (SELECT DISTINCT ON (a.event_id) a.event_id, b.location_type, b.country, b.region, b.city, b.neighborhood, b.street, b.proximity, b.source {_PAIRS} WHERE {_NESTS} AND {_COMPATIBLE}
   ORDER BY a.event_id, {_DEPTH.format(p='b.')} DESC, {_FILLED.format(p='b.')} DESC, b.event_id) m ON m.event_id = e.event_id"""))  # fmt: skip
_add("refine_in_order", lambda s, d: places.refine_locations(_full(s, d), "sequential").select("event_id", "location_type", *HIERARCHY, "proximity", "source"), None)
_IDENT = ["location_type", *[f"CASE WHEN location_type <> 'transit' THEN {c} END" for c in HIERARCHY], *TRANSIT_FIELDS, "transport_mode"]
_add("location_identity", lambda s, d: _full(s, d).groupBy("book_id", *places.location_identity()).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).select("book_id", "n", "first"),
     duck(_both, f"SELECT book_id, count(*) AS n, min(event_id) AS first FROM ({_FULL}) GROUP BY book_id, {', '.join(_IDENT)}"))
_KEYED = f"SELECT *, min(event_id) OVER (PARTITION BY book_id, {', '.join(_IDENT)}) AS first FROM ({_FULL})"
_NAMED = "(" + " OR ".join(f"coalesce({c} <> '', false)" for c in TRANSIT_FIELDS) + ")"
_add("finalize_locations", lambda s, d: places.finalize_locations(_full(s, d))[1].select("book_id", "location_id", "location_type", *HIERARCHY, "proximity", "transport_mode", "source"),
     duck(_both, f"""SELECT book_id, 'loc_' || row_number() OVER (PARTITION BY book_id ORDER BY event_id) AS location_id, CASE WHEN location_type = 'transit' AND NOT {_NAMED} THEN 'ambiguous' ELSE location_type END AS location_type,
  {', '.join(f"CASE WHEN NOT (location_type = 'transit' AND {_NAMED}) THEN {c} END AS {c}" for c in HIERARCHY)}, proximity, CASE WHEN location_type = 'transit' AND {_NAMED} THEN transport_mode END AS transport_mode, source FROM ({_KEYED}) WHERE event_id = first"""))  # fmt: skip
_add("finalize_events", lambda s, d: places.finalize_locations(_full(s, d).drop("location_id"))[0].select("event_id", "location_id"),
     duck(_both, f"SELECT event_id, 'loc_' || dense_rank() OVER (PARTITION BY book_id ORDER BY first) AS location_id FROM ({_KEYED})"))
_foreign = lambda: F.element_at(F.array(*[F.lit(f" {a.upper()} ") for a, _ in COUNTRY_ALIASES]), (F.col("location_id") % len(COUNTRY_ALIASES) + 1).cast("int"))


def _with_countries(s, d):
    rows = view(s, d, "locations").withColumn("country_normalized", F.col("location_id") % 5 == 0)
    return rows.withColumn("country", F.when((F.col("country").isNotNull()) & (F.col("location_id") % 2 == 0), _foreign()).otherwise(F.col("country")))


_CASE = "CASE location_id % 10 " + " ".join(f"WHEN {n} THEN '{a.upper()}'" for n, (a, _) in enumerate(COUNTRY_ALIASES)) + " END"
_ENGLISH = "CASE location_id % 10 " + " ".join(f"WHEN {n} THEN '{b}'" for n, (_, b) in enumerate(COUNTRY_ALIASES)) + " END"
_SCAN = "location_type = 'real' AND country IS NOT NULL AND location_id % 5 <> 0"
_add("normalize_country", lambda s, d: places.normalize_country(_with_countries(s, d)).select("location_id", "country", "country_normalized", "country_changed"),
     duck("locations", f"SELECT location_id, CASE WHEN {_SCAN} AND location_id % 2 = 0 THEN {_ENGLISH} WHEN country IS NOT NULL AND location_id % 2 = 0 THEN ' ' || {_CASE} || ' ' ELSE country END AS country, location_id % 5 = 0 OR coalesce({_SCAN}, false) AS country_normalized, coalesce({_SCAN} AND location_id % 2 = 0, false) AS country_changed FROM locations"))
_LEVEL = "CASE WHEN street IS NOT NULL THEN 'street' WHEN neighborhood IS NOT NULL THEN 'neighborhood' WHEN city IS NOT NULL THEN 'city' WHEN region IS NOT NULL THEN 'region' WHEN country IS NOT NULL THEN 'country' END"


def _deepest(s, d):
    level, value = places.deepest_level()
    return view(s, d, "locations").select("location_id", level.alias("level"), value.alias("value"))


_add("deepest_index", lambda s, d: view(s, d, "locations").select("location_id", places.deepest_index().alias("n")),
     duck("locations", "SELECT location_id, CASE WHEN street IS NOT NULL THEN 4 WHEN neighborhood IS NOT NULL THEN 3 WHEN city IS NOT NULL THEN 2 WHEN region IS NOT NULL THEN 1 WHEN country IS NOT NULL THEN 0 ELSE -1 END AS n FROM locations"))
_add("deepest_level", _deepest, duck("locations", f"SELECT location_id, {_LEVEL} AS level, coalesce(street, neighborhood, city, region, country) AS value FROM locations"))


# The gazetteer answers for a city, region or country by the customer's nation.
def _gazetteer(s, d):
    g = view(s, d, "gazetteer").withColumn("answer", F.col("value")).drop("value")
    keys = view(s, d, "locations").filter("location_type = 'real'").withColumn("_l", places.deepest_level()[0]).withColumn("_v", places.deepest_level()[1]).select(F.col("_l").alias("level"), F.col("_v").alias("value")).filter("level IS NOT NULL").distinct()
    return keys.join(g, F.concat(F.lit("NATION_"), (F.length("value") + F.ascii(F.reverse("value"))) % 25) == F.col("answer")).drop("answer")


_GAZ = f"""SELECT k.level, k.value, g.rank, g.display_name, g.importance, g.addresstype, g.place_city, g.place_country, g.place_region FROM (SELECT DISTINCT {_LEVEL} AS level, coalesce(street, neighborhood, city, region, country) AS value FROM locations
  WHERE location_type = 'real' AND {_LEVEL} IS NOT NULL) k JOIN gazetteer g ON g.value = 'NATION_' || ((length(k.value) + ascii(right(k.value, 1))) % 25)"""
_SAME = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, value, CASE WHEN place_city IS NULL THEN rank END, place_city, CASE WHEN place_city IS NOT NULL THEN place_country END ORDER BY rank) AS m FROM
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, value, display_name ORDER BY rank) AS n FROM ({_GAZ})) WHERE n = 1)) WHERE m = 1"""
_ACCEPT = f"""SELECT * FROM (SELECT * EXCLUDE (n, m), row_number() OVER (PARTITION BY level, value ORDER BY rank) AS n, lead(importance) OVER (PARTITION BY level, value ORDER BY rank) AS nxt FROM ({_SAME}))
  WHERE n = 1 AND (nxt IS NULL OR importance - nxt >= 0.05) AND CASE level WHEN 'country' THEN addresstype = 'country' WHEN 'region' THEN addresstype IN ('state', 'region') WHEN 'city' THEN addresstype IN ('city', 'town', 'village', 'municipality', 'county') ELSE true END"""
_gz = "locations gazetteer"
_keyed = ["level", "value"]
_add("geo_same_place", lambda s, d: places.geo_same_place(_gazetteer(s, d), _keyed).select("level", "value", "rank"), duck(_gz, f"SELECT level, value, rank FROM ({_SAME})"))
_add("geo_accept", lambda s, d: places.geo_accept(_gazetteer(s, d), _keyed).select("level", "value", "rank"), duck(_gz, f"SELECT level, value, rank FROM ({_ACCEPT})"))


def _backfill_sql(where="true", put="coalesce({v}, l.{c})"):
    above = {"country": "AND _level <> 'country'", "region": "AND _level NOT IN ('country', 'region')", "city": "AND _level NOT IN ('country', 'region', 'city')"}
    fill = {c: f"CASE WHEN location_type = 'real' {a} THEN g.place_{c} END" for c, a in above.items()}
    return f"""SELECT location_id, {', '.join(f'{put.format(v=v, c=c)} AS {c}' for c, v in fill.items())}, CASE WHEN location_type <> 'real' OR _level IS NULL THEN 'skipped' WHEN coalesce({', '.join(fill.values())}) IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS geocode_status
  FROM (SELECT *, {_LEVEL} AS _level, coalesce(street, neighborhood, city, region, country) AS _value FROM locations WHERE {where}) l LEFT JOIN ({_ACCEPT}) g ON g.level = _level AND g.value = _value"""


_gcols = ["location_id", "country", "region", "city", "geocode_status"]
_add("geo_backfill", lambda s, d: places.geo_backfill(view(s, d, "locations"), _gazetteer(s, d)).select(*_gcols), duck(_gz, _backfill_sql()))
_add("geo_backfill_keep", lambda s, d: places.geo_backfill(view(s, d, "locations"), _gazetteer(s, d), overwrite=False).select(*_gcols), duck(_gz, _backfill_sql(put="coalesce(l.{c}, {v})")))
_AGAIN = "location_type = 'real' AND geocode_status <> 'resolved'"
_add("regeocode", lambda s, d: places.regeocode(view(s, d, "locations"), _gazetteer(s, d)).select(*_gcols),
     duck(_gz, f"SELECT location_id, country, region, city, geocode_status FROM locations WHERE NOT ({_AGAIN}) UNION ALL SELECT * FROM ({_backfill_sql(_AGAIN)})"))


def _geo_answers(s, d):
    g = view(s, d, "gazetteer")
    return g.select(F.col("value").alias("country"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("city"), "rank", "display_name", "importance", F.lit("country").alias("addresstype"), "place_city", "place_country",
                    F.when(F.col("rank") % 5 == 0, "x").otherwise((F.col("rank") % 90).cast("string")).alias("lat"), (F.col("rank") % 180).cast("string").alias("lon"))


_add("geocode_one", lambda s, d: places.geocode_one(read(s, d, "nation").select(F.col("n_name").alias("country"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("city")), _geo_answers(s, d)).select("country", "lat", "lon"),
     duck("gazetteer", """SELECT n_name AS country, lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon FROM nation LEFT JOIN (SELECT value, CASE WHEN rank % 5 <> 0 THEN (rank % 90)::DOUBLE END AS lat, (rank % 180)::DOUBLE AS lon FROM
  (SELECT *, row_number() OVER (PARTITION BY value ORDER BY rank) AS k, lead(importance) OVER (PARTITION BY value ORDER BY rank) AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY value, CASE WHEN place_city IS NULL THEN rank END, place_city ORDER BY rank) AS m FROM
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value, display_name ORDER BY rank) AS n FROM gazetteer) WHERE n = 1)) WHERE m = 1) WHERE k = 1 AND (nxt IS NULL OR importance - nxt >= 0.05)) ON value = n_name"""))  # fmt: skip

# People.
_add("evidence_sample", lambda s, d: people.evidence_sample(view(s, d, "presence")).select("event_id"),
     duck("presence", "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY book_id, character_id) AS n, row_number() OVER (PARTITION BY book_id, character_id ORDER BY chapter, narration_order, event_id) AS k FROM presence) WHERE n <= 10 OR k <= 5 OR k > n - 5"))
_add("dedup_context", lambda s, d: people.dedup_context(view(s, d, "characters"), view(s, d, "presence")).select("character_id", F.size("evidence").alias("n"), F.array_join(F.transform("evidence", lambda x: x["chapter"].cast("string")), ",").alias("chapters")),
     duck("characters presence", """SELECT c.character_id, count(e.event_id)::INT AS n, coalesce(string_agg(e.chapter::VARCHAR, ',' ORDER BY e.chapter, e.narration_order), '') AS chapters FROM characters c LEFT JOIN (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY book_id, character_id) AS n,
  row_number() OVER (PARTITION BY book_id, character_id ORDER BY chapter, narration_order, event_id) AS k FROM presence) WHERE n <= 10 OR k <= 5 OR k > n - 5) e ON e.book_id = c.book_id AND e.character_id = c.character_id GROUP BY c.character_id"""))  # fmt: skip
_add("split_groups", lambda s, d: people.split_groups(view(s, d, "dup_groups"))[0].select("book_id", "position"), duck("dup_groups", "SELECT book_id, position FROM dup_groups WHERE confidence = 'certain'"))

_add("split_groups_rest", lambda s, d: people.split_groups(view(s, d, "dup_groups"))[1].select("book_id", "position", "confidence"),
     duck("dup_groups", "SELECT book_id, position, confidence FROM dup_groups WHERE confidence IS DISTINCT FROM 'certain'"))


# Certain groups, and chains: a group's canonical member goes to the next nation's, up to every fourth.
def _members(s, d):
    m = view(s, d, "dup_members").filter("confidence = 'certain'")
    chain = m.select("book_id", "position", F.col("canonical_id").alias("member_id")).distinct()
    nxt = chain.select("book_id", (F.col("position") - 100).alias("position"), F.col("member_id").alias("canonical_id"))
    chain = chain.join(nxt, ["book_id", "position"]).filter("floor(position / 100) % 4 <> 3").select("book_id", (F.col("position") + 100000).alias("position"), "canonical_id", "member_id")
    return m.select("book_id", "position", "canonical_id", "member_id").unionByName(chain)


_MEMBERS = """WITH RECURSIVE m AS (SELECT book_id, position, canonical_id, member_id FROM dup_members WHERE confidence = 'certain'), ch AS (SELECT DISTINCT book_id, position, canonical_id FROM m),
  allm AS (SELECT * FROM m UNION ALL SELECT a.book_id, a.position + 100000, b.canonical_id, a.canonical_id FROM ch a JOIN ch b ON b.book_id = a.book_id AND b.position = a.position + 100 WHERE (a.position // 100) % 4 <> 3),
  direct AS (SELECT book_id, member_id AS old_id, max_by(canonical_id, position) AS new_id FROM allm WHERE member_id <> canonical_id GROUP BY book_id, member_id),
  walk AS (SELECT book_id, old_id, new_id, 1 AS step FROM direct UNION ALL SELECT w.book_id, w.old_id, x.new_id, step + 1 FROM walk w JOIN direct x ON x.book_id = w.book_id AND x.old_id = w.new_id),
  redirect AS (SELECT book_id, old_id, max_by(new_id, step) AS new_id FROM walk GROUP BY book_id, old_id)"""


def _recursive(names: str, body: str) -> str:
    """Engine tables and the recursive ones in one WITH."""
    head = duck(names, "").rstrip()
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _MEMBERS.removeprefix("WITH RECURSIVE ") + "\n" + body


_add("redirect_map", lambda s, d: people.redirect_map(_members(s, d)), _recursive("dup_groups dup_members", "SELECT book_id, old_id, new_id FROM redirect"))
_aliased = lambda s, d: view(s, d, "characters").withColumn("aliases", F.when(F.col("character_id") % 2 == 0, F.array(F.concat(F.lit("Alias "), F.col("character_id").cast("string")))).otherwise(F.array().cast("array<string>")))
_ALIASED = "SELECT *, CASE WHEN character_id % 2 = 0 THEN ['Alias ' || character_id] ELSE []::VARCHAR[] END AS aliases FROM characters"
_add("apply_merges", lambda s, d: people.apply_merges(_aliased(s, d), view(s, d, "presence"), people.redirect_map(_members(s, d)))[0].select("book_id", "character_id", F.array_join("aliases", "|").alias("aliases")),
     _recursive("characters dup_groups dup_members", f"""SELECT c.book_id, c.character_id, array_to_string(CASE WHEN n.names IS NULL THEN c.aliases ELSE list_sort(list_distinct(list_concat(c.aliases, n.names))) END, '|') AS aliases FROM ({_ALIASED}) c
  LEFT JOIN (SELECT r.book_id, r.new_id, flatten(list(list_concat([o.canonical_name], o.aliases))) AS names FROM redirect r JOIN ({_ALIASED}) o ON o.book_id = r.book_id AND o.character_id = r.old_id GROUP BY r.book_id, r.new_id) n ON n.book_id = c.book_id AND n.new_id = c.character_id
  WHERE NOT EXISTS (SELECT 1 FROM redirect r WHERE r.book_id = c.book_id AND r.old_id = c.character_id)"""))  # fmt: skip
_add("apply_merges_events", lambda s, d: people.apply_merges(_aliased(s, d), view(s, d, "presence"), people.redirect_map(_members(s, d)))[1].select("event_id", "character_id"),
     _recursive("presence dup_groups dup_members", "SELECT e.event_id, coalesce(r.new_id, e.character_id) AS character_id FROM presence e LEFT JOIN redirect r ON r.book_id = e.book_id AND r.old_id = e.character_id"))


def _flags(s, d):
    m = view(s, d, "dup_members").filter("confidence <> 'certain'")
    flag = m.groupBy("book_id", "position", "canonical_id", "confidence").agg(F.array_sort(F.collect_list("member_id")).alias("character_ids"))
    status = F.when(F.col("position") % 5 == 0, "approved").otherwise("pending")
    return flag.withColumn("flag_id", F.concat_ws("-", "book_id", "position")).withColumn("status", status)


_FLAGS = "SELECT book_id || '-' || position AS flag_id, book_id, canonical_id, confidence, list_sort(list(member_id)) AS character_ids, CASE WHEN position % 5 = 0 THEN 'approved' ELSE 'pending' END AS status FROM dup_members WHERE confidence <> 'certain' GROUP BY book_id, position, canonical_id, confidence"
_ft = "books characters presence dup_groups dup_members"
_add("flags_pending", lambda s, d: people.flags_pending(_flags(s, d), view(s, d, "books"), view(s, d, "characters").filter("character_id % 9 <> 0")),
     duck(_ft, f"""SELECT flag_id, f.book_id, b.title, confidence, canonical_id, string_agg(coalesce(c.canonical_name, '?'), ', ' ORDER BY m) AS members FROM (SELECT *, unnest(character_ids) AS m FROM ({_FLAGS}) WHERE status = 'pending') f JOIN books b ON b.book_id = f.book_id
  LEFT JOIN (SELECT * FROM characters WHERE character_id % 9 <> 0) c ON c.book_id = f.book_id AND c.character_id = m GROUP BY flag_id, f.book_id, b.title, confidence, canonical_id"""))  # fmt: skip


def _some_flag(s, d):
    return _flags(s, d).filter("status = 'pending'").agg(F.min("flag_id")).first()[0]


_ONE = f"SELECT * FROM ({_FLAGS}) WHERE status = 'pending' ORDER BY flag_id LIMIT 1"
_add("flag_approve", lambda s, d: people.flag_approve(_some_flag(s, d), _flags(s, d), _aliased(s, d), view(s, d, "presence"))[1].select("book_id", "character_id", F.array_join("aliases", "|").alias("aliases")),
     duck(_ft, f"""SELECT c.book_id, c.character_id, array_to_string(CASE WHEN c.character_id = f.canonical_id THEN (SELECT list_sort(list_distinct(list_filter(flatten(list(list_concat([o.canonical_name], o.aliases))), lambda x: x <> c.canonical_name))) FROM ({_ALIASED}) o WHERE o.book_id = f.book_id AND list_contains(f.character_ids, o.character_id)) ELSE c.aliases END, '|') AS aliases
  FROM ({_ALIASED}) c LEFT JOIN ({_ONE}) f ON f.book_id = c.book_id WHERE f.book_id IS NULL OR c.character_id = f.canonical_id OR NOT list_contains(f.character_ids, c.character_id)"""))  # fmt: skip
_add("flag_approve_events", lambda s, d: people.flag_approve(_some_flag(s, d), _flags(s, d), _aliased(s, d), view(s, d, "presence"))[2].select("event_id", "character_id"),
     duck(_ft, f"SELECT e.event_id, CASE WHEN f.book_id IS NOT NULL THEN f.canonical_id ELSE e.character_id END AS character_id FROM presence e LEFT JOIN ({_ONE}) f ON f.book_id = e.book_id AND list_contains(f.character_ids, e.character_id)"))
_add("flag_approve_flags", lambda s, d: people.flag_approve(_some_flag(s, d), _flags(s, d), _aliased(s, d), view(s, d, "presence"))[0].select("flag_id", "status"),
     duck(_ft, f"SELECT flag_id, CASE WHEN flag_id = (SELECT flag_id FROM ({_ONE})) THEN 'approved' ELSE status END AS status FROM ({_FLAGS})"))
_add("flag_reject", lambda s, d: people.flag_reject(_some_flag(s, d), _flags(s, d)).select("flag_id", "status"),
     duck(_ft, f"SELECT flag_id, CASE WHEN flag_id = (SELECT flag_id FROM ({_ONE})) THEN 'rejected' ELSE status END AS status FROM ({_FLAGS})"))

# Ranking and usage.
_works = lambda s, d: read(s, d, "part").select(F.col("p_brand").alias("work"), F.when(_k() % 8 != 0, F.col("p_name")).alias("label"), F.col("p_size").alias("sitelinks"), F.col("p_retailprice").alias("pageviews"), _k().alias("position"))
_add("rank_characters", lambda s, d: ranking.rank_characters(_works(s, d), 5).select("work", "label", "position", "rank"),
     "SELECT work, label, position, rank::INT AS rank FROM (SELECT p_brand AS work, p_name AS label, p_partkey AS position, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_partkey % 8 <> 0) WHERE rank <= 5")
_hits = lambda s, d: read(s, d, "part").select(F.col("p_brand").alias("request"), _k().alias("position"), F.concat(F.when(_k() % 3 == 0, "1850 novel by ").when(_k() % 3 == 1, "film by ").otherwise("literary work by "), "p_name").alias("description"), F.lit("Widget, A").alias("author"))
_add("match_work", lambda s, d: ranking.match_work(_hits(s, d)).select("request", "position"), "SELECT p_brand AS request, min(p_partkey) AS position FROM part WHERE p_partkey % 3 <> 1 AND contains(lower(p_name), 'widget') GROUP BY p_brand")
_add("rich_works", lambda s, d: ranking.rich_works(_works(s, d).select("work").distinct().withColumn("title", F.concat(F.lit("On "), "work")), _works(s, d).filter("label IS NOT NULL"), 3, 10),
     "SELECT work, 'On ' || work AS title, characters FROM (SELECT p_brand AS work, count(*) AS characters FROM part WHERE p_partkey % 8 <> 0 GROUP BY p_brand HAVING count(*) >= 3) ORDER BY characters DESC, work LIMIT 10")
_add("pageviews_sum", lambda s, d: ranking.pageviews_sum(read(s, d, "orders").select(F.col("o_custkey").alias("page"), F.to_date("o_orderdate").alias("day"), F.lit(1).alias("views")), read(s, d, "customer").select(F.col("c_custkey").alias("page")), datetime.date(1999, 1, 3)),
     "SELECT c_custkey AS page, coalesce(n, 0) AS views FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1999-01-01' GROUP BY o_custkey) ON o_custkey = c_custkey")
_PRICES = " UNION ALL ".join(f"SELECT '{m}' AS model, {i} AS i, {o} AS o" for m, i, o in adapters.PRICES)


def _usage(s, d):
    rows = ranking.usage_summary(view(s, d, "usage_log"), s.createDataFrame(list(adapters.PRICES), "model string, input_rate double, output_rate double"))
    return rows.withColumn("cost", F.round("cost", 6))


_add("usage_summary", _usage, duck("usage_log", f"""SELECT u.model, calls, input_tokens::BIGINT AS input_tokens, cache_write_tokens::BIGINT AS cache_write_tokens, cache_read_tokens::BIGINT AS cache_read_tokens, output_tokens::BIGINT AS output_tokens,
  round((pi * coalesce(i, 0)::DOUBLE + pw * coalesce(i, 0)::DOUBLE * 1.25::DOUBLE + pr * coalesce(i, 0)::DOUBLE * 0.1::DOUBLE + po * coalesce(o, 0)::DOUBLE) / 1000000, 6) AS cost FROM (SELECT model, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(cache_write_tokens) AS cache_write_tokens, sum(cache_read_tokens) AS cache_read_tokens, sum(output_tokens) AS output_tokens,
  sum(CASE WHEN cli THEN 0 ELSE input_tokens END) AS pi, sum(CASE WHEN cli THEN 0 ELSE cache_write_tokens END) AS pw, sum(CASE WHEN cli THEN 0 ELSE cache_read_tokens END) AS pr, sum(CASE WHEN cli THEN 0 ELSE output_tokens END) AS po FROM usage_log GROUP BY model) u LEFT JOIN ({_PRICES}) p ON p.model = u.model"""))  # fmt: skip
_RATED = " + ".join(f"u.{c} * coalesce({r}, 0)::DOUBLE * {w}::DOUBLE" for c, r, w in (("input_tokens", "i", 1), ("cache_write_tokens", "i", 1.25), ("cache_read_tokens", "i", 0.1), ("output_tokens", "o", 1)))


def _usage_total(s, d):
    rows = ranking.usage_total(view(s, d, "usage_log"), s.createDataFrame(list(adapters.PRICES), "model string, input_rate double, output_rate double"))
    return rows.select("calls", F.round("cost", 4).alias("cost"), F.round("equivalent_cost", 4).alias("equivalent_cost"))


_add("usage_total", _usage_total,
     duck("usage_log", f"""SELECT count(*) AS calls, round(sum(CASE WHEN cli THEN 0 ELSE {_RATED} END) / 1000000, 4) AS cost, round(sum(CASE WHEN cli THEN {_RATED} ELSE 0 END) / 1000000, 4) AS equivalent_cost
  FROM usage_log u LEFT JOIN ({_PRICES}) p ON p.model = u.model"""))  # fmt: skip
_add("run_totals", lambda s, d: ranking.run_totals(view(s, d, "usage_log")), duck("usage_log", "SELECT count(*) AS runs, sum(elapsed) AS elapsed, sum(output_tokens)::BIGINT AS output_tokens FROM usage_log WHERE elapsed IS NOT NULL"))

# Store.
_ids = lambda s, d: view(s, d, "characters").select("book_id", F.col("character_id").alias("old_id"), F.md5(F.concat_ws("-", "book_id", F.col("character_id").cast("string")).cast("binary")).alias("new_id"))
_add("id_remap_members", lambda s, d: store.id_remap_members(_flags(s, d).select("book_id", "flag_id", "character_ids"), _ids(s, d), "character_ids", "flag_id").select("book_id", "flag_id", F.array_join("character_ids", ",").alias("members")),
     duck("dup_groups dup_members", f"SELECT book_id, flag_id, array_to_string(list_transform(character_ids, lambda x: md5(book_id || '-' || x)), ',') AS members FROM ({_FLAGS})"))
_add("id_remap", lambda s, d: store.id_remap(view(s, d, "presence").select("event_id", "book_id", "character_id"), _ids(s, d), "character_id"), duck("presence", "SELECT event_id, book_id, md5(book_id || '-' || character_id) AS character_id FROM presence"))


def _nested(s, d):
    e = view(s, d, "presence")
    h = F.struct(*[F.col("time_" + c).alias(c) for c in ("year_range_start", "year_range_end", "year", "month", "day")])
    time = F.struct(h.alias("hierarchy"), F.col("time_precision").alias("precision"), F.col("time_source").alias("source"))
    sequence = F.struct("narration_order", F.lit(None).cast("int").alias("story_chronological_order"))
    return e.withColumn("time", time).withColumn("sequence", sequence).withColumn("ordering_confidence", F.lit("certain")).withColumn("confidence", F.lit("explicit")).drop(*[c for c in e.columns if c.startswith("time_")], "narration_order")


_FLAT = ", ".join(("event_id", "book_id", "character_id", "location_id", "chapter", *_TCOLS, "narration_order"))
_add("flatten_events", lambda s, d: fold.flatten_events(_nested(s, d)), duck("presence", f"SELECT {_FLAT}, NULL::INT AS story_chronological_order, 'certain' AS ordering_confidence, temporal_relation, evidence_quote, 'explicit' AS confidence FROM presence"))
_add("book_counts", lambda s, d: store.book_counts(*(view(s, d, n) for n in ("books", "characters", "locations", "presence"))),
     duck("books characters locations presence", "SELECT book_id, (SELECT count(*) FROM characters c WHERE c.book_id = b.book_id) AS characters, (SELECT count(*) FROM locations l WHERE l.book_id = b.book_id) AS locations, (SELECT count(*) FROM presence e WHERE e.book_id = b.book_id) AS events FROM books b"))
_add("already_processed", lambda s, d: store.already_processed(read(s, d, "part").select(_k().alias("gutenberg_id")), read(s, d, "lineitem").filter("l_partkey % 2 = 0").select(F.col("l_partkey").alias("gutenberg_id"))),
     "SELECT p_partkey AS gutenberg_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 2 = 0)")
_add("reprocess_candidates", lambda s, d: store.reprocess_candidates(read(s, d, "part").select(_k().alias("book_id"), (F.col("p_size") * 4).alias("chapters"), F.when(_k() % 4 != 0, F.col("p_size") + _k() % 200).alias("chapters_processed"))),
     "SELECT p_partkey AS book_id, p_size * 4 AS chapters, CASE WHEN p_partkey % 4 <> 0 THEN p_size + p_partkey % 200 END AS chapters_processed, CASE WHEN p_size * 4 > 120 THEN 'kept' WHEN p_partkey % 4 <> 0 AND p_size + p_partkey % 200 >= p_size * 4 THEN 'done' ELSE 'reprocess' END AS action FROM part")
