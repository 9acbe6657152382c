import collections
import hashlib
import random
import re
import time

import numpy as np
import xxhash
from util import documents, prose, some_rows

from chronotopia.llm import simhash, suffix_dedup


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    comp = dict(zip(range(len(ids)), ids))
    while True:
        new = dict(comp)
        for i, j in linked:
            new[i] = new[j] = min(new[i], new[j])
        if new == comp:
            return [comp[i] for i in range(len(ids))]
        comp = new


def test_simhash_is_as_brute_force(spark, tmp_path):
    rows = some_rows()
    d = documents(spark, tmp_path, rows)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, d).collect())
    fps = [fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = roots([i for i, _ in rows], linked)
    assert got == sorted((r[0], format(f, "016x"), c) for r, f, c in zip(rows, fps, want))
    kept = simhash.near_dedup(spark.read.parquet(f"{d}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns[-1] == "component_id"


def test_one_row_of_each_group_stays_whatever_its_doc_id(spark, tmp_path):
    rng = random.Random(8)
    alone, near, other, null, both = (prose(rng, 150) for _ in range(5))
    rows = [(None, alone), (3, near), (5, near + " "), (5, other), (None, null), (None, null), (None, null + "  "), (7, both), (None, both), (9, both, "fr")]
    docs = spark.read.parquet(f"{documents(spark, tmp_path, rows)}/documents.parquet")
    for parts in (1, 7):
        kept = simhash.near_dedup(docs.repartition(parts)).collect()
        got = sorted(((r.doc_id, r.text.strip()) for r in kept), key=str)
        assert got == sorted([(None, alone), (3, near), (5, other), (None, null), (7, both)], key=str)
        assert parts == 1 or kept and sorted(map(str, kept)) == before
        before = sorted(map(str, kept))


def test_large_signatures_go_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    family = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))}
    fps = sorted(family | {int(x) for x in rng.integers(0, 2**63, 200)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (2048, 32):
        edges = [(r.a, r.b) for r in simhash.links(df, block=block).collect()]
        at = {f: i for i, f in enumerate(fps)}
        got = roots(fps, [(at[a], at[b]) for a, b in edges])
        want = roots(fps, [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
        assert got == want


def brute_removal(texts, length=200):
    raw, count = [(t or "").encode() for t in texts], collections.Counter()
    for b in raw:
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffix_dedup_is_as_brute_force(spark, tmp_path):
    rows = [r for r in some_rows(3) if r[0] != 404] + [(500, "ab" * 150 + "\0" * 210), (501, "x" + "ab" * 120), (502, "\0" * 205)]
    d = documents(spark, tmp_path, rows, "spans")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op8_suffix_dedup(spark, d).collect())
    assert got == sorted((r[0], *w) for r, w in zip(rows, brute_removal([t for _, t in rows])))


def equal_rows(spark, n):
    """``n`` equal rows without an id, a longer text that holds theirs, a short one repeated, and one alone."""
    rng = random.Random(4)
    text, short, alone = prose(rng, 80), "short " * 5, prose(rng, 90)
    rows = spark.range(n).selectExpr("cast(null as long) AS doc_id", f"'{text}' AS text")
    more = [(1, "before " + text + " after"), (2, short), (2, short), (3, alone)]
    return rows.unionByName(spark.createDataFrame(more, "doc_id long, text string")), text, [x for _, x in more]


def test_equal_rows_lose_all_and_other_texts_what_they_share(spark):
    for n, lost in ((1, 1), (2, 2), (300, 300)):
        docs, text, more = equal_rows(spark, n)
        got = sorted((r.n_bytes, r.kept) for r in suffix_dedup.remove(docs.repartition(5)).collect())
        rows = [text] * n + more
        want = sorted((size, bytes(kept)) for (size, *_), kept in zip(brute_removal(rows), kept_bytes(rows)))
        assert [(a, bytes(b)) for a, b in got] == want and sum(not b for _, b in want) == lost


def kept_bytes(texts, length=200):
    """What brute force leaves of each text."""
    data = [t.encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = {k for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1 for k in range(i, i + length)}
        out.append(bytes(x for k, x in enumerate(b) if k not in gone))
    return out


def test_very_many_equal_rows_take_linear_work(spark, monkeypatch):
    # With the second bound no key counts as hot, and equal rows share a list of intervals.
    for n, hot in ((100_000, suffix_dedup.HOT), (20_000, 0.5)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        start = time.monotonic()
        one = suffix_dedup.remove(equal_rows(spark, n)[0]).selectExpr("count(*)", "count_if(octet_length(kept) = 0)", "sum(size(spans))").first()
        assert tuple(one) == (n + 4, n, n + 1) and time.monotonic() - start < 60


def test_levels_find_what_one_scan_finds():
    rng = np.random.default_rng(1)
    n = 60
    right = rng.integers(0, 2, (n, 200)).astype(np.uint8) * 0 + rng.integers(0, 3, (n, 1)).astype(np.uint8)
    for i in range(n):
        right[i, rng.integers(100, 200) :] = i
    left, off = np.zeros((n, 120), np.uint8), rng.integers(0, 40, n)
    for i in range(n):
        left[i, : off[i]] = rng.integers(0, 2)

    def make(ids):
        return suffix_dedup.Level(right[ids], left[ids], off[ids], np.zeros(len(ids), np.int64), np.zeros((len(ids), 120), bool), np.array(ids))

    whole = make(list(range(n)))
    whole.scan(200)
    family = suffix_dedup.Family(200)
    for at in range(0, n, 7):
        family.add(make(list(range(at, min(n, at + 7)))))
    parts = family.finish()
    assert (whole.found[np.argsort(whole.ids)] == parts.found[np.argsort(parts.ids)]).all() and whole.found.any()
    for i in range(n):
        for d in range(int(off[i]) + 1):
            same = any(j != i and off[j] >= d and (right[i, : 200 - d] == right[j, : 200 - d]).all() and (left[i, :d] == left[j, :d]).all() for j in range(n))
            assert same == bool(whole.found[list(whole.ids).index(i), d])


def test_later_batches_meet_the_levels_of_earlier_ones(spark, tmp_path):
    rows = [r for r in some_rows(4) if r[0] != 404]
    parts = [rows[i::5] for i in range(5)]
    index, before = suffix_dedup.Index(spark, f"{tmp_path}/index", unit=16_000), []
    for n, part in enumerate(parts):
        got = index.add(spark.read.parquet(documents(spark, f"{tmp_path}/{n}", part) + "/documents.parquet"))
        got = sorted((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got.collect())
        before += part
        want = brute_removal([t for _, t in before])[-len(part) :]
        assert got == sorted((r[0], *w) for r, w in zip(part, want))
        sizes = [index._class(b) for _, b in index.levels()]
        assert len(sizes) == len(set(sizes))
    assert sum(b for _, b in index.levels()) == sum(len((t or "").encode()) for _, t in rows if len((t or "").encode()) >= 200)
    # An empty batch changes nothing.
    none = spark.read.parquet(f"{tmp_path}/0/documents.parquet").limit(0)
    assert index.add(none).collect() == []


def test_texts_are_shuffled_once(spark, tmp_path):
    d = documents(spark, tmp_path, some_rows(5))
    df = suffix_dedup.op8_suffix_dedup(spark, d)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "x")])
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    none = f"{tmp_path}/none"
    assert simhash.op9_simhash(spark, none).collect() == [] and suffix_dedup.op8_suffix_dedup(spark, none).collect() == []
