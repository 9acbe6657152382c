"""Star-schema tables read as the engine's tables.

One SQL text for each engine table, in words that Spark and DuckDB share, so that a query and its SQL counterpart
start from the same rows. Names in braces are the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS = {
    "co": """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS mo,
  CAST(day(o_orderdate) AS INT) AS d, c_name, c_mktsegment, c_nationkey, n_name, r_name
  FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "books": "SELECT DISTINCT c_mktsegment AS book_id, 'The book of ' || lower(c_mktsegment) AS title FROM {customer}",
    "characters": "SELECT c_mktsegment AS book_id, c_custkey AS character_id, c_name AS canonical_name, c_nationkey FROM {customer}",
    "locations": """SELECT co.o_orderkey AS location_id, co.c_mktsegment AS book_id,
  CASE WHEN o_orderstatus = 'P' THEN 'transit' WHEN o_orderkey % 11 = 0 THEN 'fictional' WHEN o_orderkey % 13 = 0 THEN 'ambiguous' ELSE 'real' END AS location_type,
  CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 17 <> 0 THEN co.n_name END AS country,
  CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 THEN co.r_name END AS region,
  CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 THEN ' City_' || CAST(o_custkey % 40 AS STRING) || ' ' END AS city,
  CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 = 0 THEN 'N_' || CAST(o_custkey % 7 AS STRING) END AS neighborhood,
  CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 19 = 0 THEN 'Street ' || CAST(o_custkey % 9 AS STRING) END AS street,
  CASE WHEN o_orderkey % 2 = 0 THEN 'at' ELSE 'area' END AS proximity,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 6 <> 0 THEN co.n_name END AS transit_from_country,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 <> 0 THEN 'City_' || CAST(o_custkey % 40 AS STRING) END AS transit_from_city,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 9 <> 0 THEN n2.n_name END AS transit_to_country,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 <> 0 THEN 'City_' || CAST(o_orderkey % 40 AS STRING) END AS transit_to_city,
  CASE WHEN o_orderstatus = 'P' THEN CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'on_foot' WHEN 1 THEN 'train' WHEN 2 THEN 'ship' WHEN 3 THEN 'carriage' END END AS transport_mode,
  CASE WHEN o_orderkey % 3 = 0 THEN 'inferred' ELSE 'stated' END AS source,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' ELSE 'skipped' END AS geocode_status
  FROM co JOIN {nation} n2 ON n2.n_nationkey = (co.c_nationkey + co.o_orderkey) % 25""",
    "presence": """SELECT o_orderkey AS event_id, c_mktsegment AS book_id, o_custkey AS character_id, o_orderkey AS location_id, mo AS chapter,
  CAST(o_orderkey AS INT) AS narration_order,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN y - 2 END AS time_year_range_start,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 23 <> 0 THEN y + 2 END AS time_year_range_end,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN y END AS time_year,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR (o_orderpriority = '5-LOW' AND o_orderkey % 4 = 0) THEN mo END AS time_month,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 29 <> 0 THEN d END AS time_day,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'day' WHEN '2-HIGH' THEN 'month' WHEN '3-MEDIUM' THEN 'year' WHEN '4-NOT SPECIFIED' THEN 'year_range' END AS time_precision,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 0 THEN 'book_estimated' WHEN o_orderkey % 3 = 0 THEN 'inferred' ELSE 'stated' END AS time_source,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'flashback' WHEN 1 THEN 'flash_forward' WHEN 2 THEN 'unclear' ELSE 'current' END AS temporal_relation,
  CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || CAST(o_orderkey AS STRING) END AS evidence_quote
  FROM co""",
    "estimates": """SELECT DISTINCT c_mktsegment AS book_id, CAST(1990 + length(c_mktsegment) AS INT) AS year_range_start, CAST(2000 + length(c_mktsegment) AS INT) AS year_range_end,
  CASE length(c_mktsegment) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS setting_confidence FROM {customer}""",
    "dup_groups": """SELECT c_mktsegment AS book_id, c_nationkey * 100 + c_custkey % 50 AS position, min(c_custkey) AS canonical_id, c_custkey % 50 AS slot, c_nationkey,
  CASE WHEN (c_custkey % 50) % 3 = 0 THEN 'uncertain' WHEN (c_custkey % 50) % 3 = 1 THEN 'likely' ELSE 'certain' END AS confidence
  FROM {customer} GROUP BY c_mktsegment, c_nationkey, c_custkey % 50 HAVING count(*) > 1""",
    "dup_members": """SELECT g.book_id, g.position, g.canonical_id, g.confidence, c.c_custkey AS member_id FROM dup_groups g
  JOIN {customer} c ON c.c_mktsegment = g.book_id AND c.c_nationkey = g.c_nationkey AND c.c_custkey % 50 = g.slot""",
    "gazetteer": """SELECT n_name AS value, s_suppkey AS rank, CASE WHEN s_suppkey % 7 = 0 THEN 'place' ELSE s_name END AS display_name, round(s_acctbal / 10000, 4) AS importance,
  CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'country' WHEN 1 THEN 'city' ELSE 'state' END AS addresstype,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'City_' || CAST(s_suppkey % 10 AS STRING) END AS place_city, n_name AS place_country, 'R' || CAST(s_suppkey % 5 AS STRING) AS place_region
  FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "usage_log": """SELECT event_id AS call_id, event_type AS model, event_id % 1000 AS input_tokens, event_id % 7 AS cache_write_tokens, event_id % 11 AS cache_read_tokens,
  event_id % 100 AS output_tokens, event_id % 5 = 0 AS cli, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 60 AS DOUBLE) END AS elapsed FROM {events}""",
}
#: Price of a million tokens by model: input, output (fixed values of this adapter).
PRICES = (("click", 5.0, 25.0), ("view", 3.0, 15.0), ("purchase", 1.0, 5.0))
NEEDS = {"locations": ("co",), "presence": ("co",), "dup_members": ("dup_groups",)}


def _with(names: tuple[str, ...]) -> str:
    order: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)


def duck(names: str, body: str) -> str:
    """DuckDB SQL: ``body`` over the engine tables ``names`` (space-separated)."""
    return _with(tuple(names.split())).format(**{t: t for t in TABLES}) + "\n" + body


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An engine table."""
    sql = _with((name,)) + f" SELECT * FROM {name}"
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)
