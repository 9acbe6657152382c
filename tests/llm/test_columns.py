"""Extra columns with names and types that clash with the operators' own."""

import random

import pytest
from pyspark.sql import functions as F
from util import documents, prose

from chronotopia.llm import langid, mixing, pii, simhash

NAMES = ["_row_a", "_source", "_end", "_words", "fp", "root", "_langid_score", "a.b", "x0", "size", "_n"]


@pytest.fixture
def docs(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40), "en", f"s{i % 2}") for i in range(30)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(5)]
    plain = spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet").drop("component_id")
    odd = plain.withColumns({n: F.concat(F.lit(n + " "), F.col("doc_id").cast("string")) for n in NAMES})
    return odd.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("deep", F.array(F.create_map(F.lit("k"), F.col("source"))))


def shown(df):
    return sorted((r.asDict(True) for r in df.select("doc_id", "text", "`a.b`", "_row_a", "m", "deep").collect()), key=str)


@pytest.mark.parametrize("operator", [simhash.near_dedup, mixing.mix, langid.accepted, lambda d: pii.pseudonymize(d, b"key")])
def test_extra_columns_come_through(docs, operator):
    out = operator(docs)
    assert out.dtypes == docs.dtypes
    rows = shown(out)
    assert len(rows) >= 30 and all(r["a.b"] == f"a.b {r['doc_id']}" and r["_row_a"] == f"_row_a {r['doc_id']}" and r["m"] == {"k": r["doc_id"]} for r in rows)


def test_near_dedup_keeps_one_of_each_group_of_copies(docs):
    assert [r["doc_id"] for r in sorted(shown(simhash.near_dedup(docs)), key=lambda r: r["doc_id"])] == list(range(30))


def test_keys_that_begin_alike_are_two_keys():
    long = b"k" * 64
    assert len({pii.Feistel(key, "t", 10**9).encrypt(5) for key in (long, long + b"1", long + b"2")}) == 3
