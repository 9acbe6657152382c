import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
from util import documents, prose, some_rows

from chronotopia.llm import resample as M
from chronotopia.llm.resample_sql import ORACLE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target):
    place = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(place(f) for x in side for f in features(x)[1]) for side in ([x for _, x in rows], target))
    total_s, total_t = (float(sum(c.values())) for c in (s, t))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for i, x in rows:
        w, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(g)) for g in f)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(can[: 5 * len(can) // 100]):
        r[5] = k + 1
    return sorted(map(str, ([r[0], *r[2:]] for r in out)))


def tables(spark, path, rows, target, extra="weight"):
    d = documents(spark, path, rows, extra)
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def got(df):
    return sorted(str(list(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_query_is_as_brute_force_and_sql(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = some_rows(21, 120) + [(500, "É ß ÀB x1 A-b_c 9" * 9), (501, "<tag> & 1.5"), (None, prose(rng, 50)), (None, prose(rng, 50)), (502, "\0a\0b \x7f"), (503, "straße Straße STRASSE " * 12)]
    rows += [(600 + k, prose(rng, 30)) for k in range(200)] + [(600, prose(random.Random(77), 30))] * 2
    target = [prose(rng, 40) for _ in range(12)] + [None, ""]
    d = tables(spark, tmp_path, rows, target)
    want = brute(rows, target)
    assert got(M.op12_resample(spark, d)) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    said = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({ORACLE})").fetchall()
    assert sorted(str(list(r)) for r in said) == want
    # Nearly every text in chunks, summed by document.
    monkeypatch.setattr(M, "LONG", 50)
    assert got(M.op12_resample(spark, d)) == want


def test_chunks_own_every_start_once():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab  é.-") for _ in range(rng.randint(0, 200))).encode()
        whole = collections.Counter(M.buckets(text)[1].tolist())
        parts = [M.buckets(piece, own) for piece, own in M.chunks(text, rng.randint(1, 30))]
        assert sum((collections.Counter(x.tolist()) for _, x in parts), collections.Counter()) == whole
        assert sum(n for n, _ in parts) == M.buckets(text)[0]


def test_empty_tables(spark, tmp_path):
    assert M.op12_resample(spark, tables(spark, tmp_path / "a", [], [])).collect() == []
    rows = [(i, prose(random.Random(i), 25)) for i in range(40)]
    assert got(M.op12_resample(spark, tables(spark, tmp_path / "b", rows, []))) == brute(rows, [])


def test_all_columns_of_a_long_text_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "LONG", 40)
    rows = [(i, prose(random.Random(i), 60), "en", f"s{i}") for i in range(6)] + [(9, None, "de", "z")]
    docs = spark.read.parquet(tables(spark, tmp_path, rows, ["the of and"]) + "/documents.parquet")
    out = M.weights(docs, docs, ("doc_id", "source", "text")).collect()
    assert sorted((r.doc_id, r.source, r.text) for r in out) == [(r[0], r[3], r[1]) for r in rows]
