"""Every registered query of the engine against its SQL, on the smallest tables; of the count grid only its corners."""

import os

import duckdb
import pytest

from chronotopia.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORNERS = {"time_none_loc_none_count", "time_day_loc_none_count", "time_century_loc_region_count", "time_month_loc_neighborhood_count"}
NAMES = [n for n in registry.ORACLES if not n.endswith("_count") or n in CORNERS or not n.startswith("time_")]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(show(v) for v in r) for r in rows), key=lambda r: tuple(v or "" for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_is_as_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    said = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in said.description]
    want = plain(said.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert plain(tuple(r) for r in df.select(*cols).collect()) == want
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + registry.ORACLES[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds


def test_all_have_names_of_their_own():
    assert len(registry.QUERIES) == sum(len(p.QUERIES) for p in registry.PARTS) and set(registry.ORACLES) <= set(registry.QUERIES)
