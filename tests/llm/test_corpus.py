import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import documents, prose, some_rows

import corpus_pipeline
from chronotopia.llm import bpe, langid, mixing, sharding, simhash


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.PairIndexBPE(open(bpe.default_path(), "rb").read())


def test_bpe_is_as_the_library(tokenizer):
    from tokenizers import Tokenizer

    ref, rng = Tokenizer.from_file(bpe.default_path()), random.Random(4)
    letters = " \n\t\r'stremdlvaAé’ß1२🙂aaaa​　\x1c\x85.,"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", "'re", "<|endoftext|><|endoftext|> x"]) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 400, prose(rng, 3000)] + [chr(c) + "x " + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for got, want, text in zip(tokenizer.encode(texts), ref.encode_batch(texts, add_special_tokens=False), texts):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == want.ids
        assert tokenizer.decode(ids) == ref.decode(want.ids, skip_special_tokens=False) == text


def test_bpe_query_and_round_trip(spark, tmp_path, tokenizer):
    rows = some_rows(5)
    d = documents(spark, tmp_path, rows, "token_ids")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_bpe(spark, d).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((i, len(x) // 4, sha(x), sha((t or "").encode())) for (i, t), x in zip(rows, tokenizer.encode([t for _, t in rows])))
    back = bpe.decode(bpe.encode(spark.read.parquet(f"{d}/documents.parquet"), bpe.default_path()), bpe.default_path())
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t in rows)


def languages(seed=1, n=300):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang, letters = [("aa", "abcdea"), ("bb", "vwxyzé"), ("cc", "aevzoß")][i % 3]
        out.append((i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 60))).capitalize() + ".", lang))
    return out


def test_language_id(spark, tmp_path):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ...", None), (1003, "Щука плыла", None), (1004, "abcde " * 30_000, None), (1004, "abcde", None), (None, "vwx yz", "bb")]
    d = documents(spark, tmp_path, languages() + odd, "lang_pred")
    rows = langid.op2_langid(spark, d).collect()
    assert len(rows) == 307 and all(0 <= r.score <= 1 for r in rows)
    want = {i: k for i, _, k in languages()}
    held = [r for r in rows if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held) > 20
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].rejected and not any(r.rejected for r in held)
    assert by[1004].lang_pred == "aa" and by[None].lang_pred == "bb"


def test_language_without_calibration_documents_still_rejects(spark, tmp_path):
    rng = random.Random(9)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40))
    ids = [i for i in range(2000, 2200) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)][:40]
    fresh = [i for i in range(3000, 3040)]
    rows = languages() + [(i, text("ijklmn"), "dd") for i in ids] + [(i, text("ijklmn"), None) for i in fresh] + [(4000 + i, text("ijжщфцб"), None) for i in range(20)]
    by = {r.doc_id: r for r in langid.op2_langid(spark, documents(spark, tmp_path, rows)).collect()}
    assert {by[i].lang_pred for i in [*ids, *fresh, *range(4000, 4020)]} == {"dd"}
    assert not any(by[i].rejected for i in [*ids, *fresh]) and all(by[4000 + i].rejected for i in range(20))


def test_language_model_is_a_distribution():
    texts = [t for _, t, k in languages(2, 30) if k == "aa"]
    key, *_ = langid.grams(texts)
    m = langid.Model.fit(["aa"], [tuple(np.unique(key, return_counts=True))])
    for context in np.unique(key >> np.uint64(16))[:20]:
        letters = np.unique(key & np.uint64(0xFFFF))
        p = np.exp(m.log_p((context << np.uint64(16)) | letters)).sum()
        assert 0.9 < p < 1.0 + 1e-4  # the rest is left to letters not seen
    assert abs(np.exp(m.log_p(np.array([0x41B041B041B041B], np.uint64))).sum() - np.exp(m.log_p(np.array([0x42042042042], np.uint64))).sum()) < 1e-6


def kneser_ney(texts):
    """Interpolated Kneser-Ney of one language by dictionaries, straight from its definition: (counts, discount) of each order."""
    counts = collections.Counter(g for t in texts for g in windows(t))
    orders = []
    for _ in range(langid.ORDER):
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        orders.insert(0, (counts, min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.75))
        counts = collections.Counter(g[1:] for g in counts)
    return orders


def windows(text):
    own = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).lstrip(" ")
    padded = " " * langid.PAD + own
    return [padded[i : i + langid.ORDER] for i in range(len(own))]


def probability(orders, gram, letters):
    if not gram:
        return 1 / (letters + 1)
    counts, d = orders[len(gram) - 1]
    lower = probability(orders, gram[1:], letters)
    after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
    return (max(0, counts[gram] - d) + d * len(after) * lower) / sum(after) if after else lower


def test_language_model_is_as_dictionaries():
    rows, rng = languages(7, 24), random.Random(8)
    by = {k: [t for _, t, x in rows if x == k] for k in ("aa", "bb", "cc")}
    counted = [np.unique(langid.grams(ts)[0], return_counts=True) for ts in by.values()]
    m = langid.Model.fit(list(by), counted)
    orders = [kneser_ney(ts) for ts in by.values()]
    letters = len({g[-1] for o in orders for g in o[0][0]})
    texts = ["Abc, dea 12 bad", "vwéx zv", "qqq abc", "x", " ?ß. ", "жук", *("".join(rng.choice("abvwzoßq .") for _ in range(20)) + "a" for _ in range(10))]
    best, _, h, n = m.score(texts)
    for text, k, got, size in zip(texts, best, h, n):
        sums = [sum(np.log(probability(o, g, letters)) for g in windows(text)) for o in orders]
        assert size == len(windows(text)) and abs(got + max(sums) / size) < 1e-4 and sums[k] > max(sums) - 1e-4


def test_languages_that_were_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.filter(langid._held(0))
    share = lambda docs, m: [r for r in langid.predict(docs.filter("text IS NOT NULL"), m, ("lang",)).collect() if r.lang is not None]
    assert not any(r.rejected for r in share(held, langid.train(docs)))
    found = share(held, langid.train(docs.filter("lang <> 'fr'")))
    own, foreign = [r.rejected for r in found if r.lang != "fr"], [r.rejected for r in found if r.lang == "fr"]
    assert sum(own) <= 0.02 * len(own) and sum(foreign) >= 0.8 * len(foreign) > 10


def test_without_labels_nothing_is_known(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "abc", None), (2, None, None)])
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.op2_langid(spark, d).collect()] == [("und", 0.0, True)] * 2


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == [187.5, 75.0, 37.5]
    got = mixing.targets([("a", 10), ("b", 500), ("c", 90), ("d", 0)])
    assert got[0] == 30 and got[3] == 0 and abs(sum(got) - 600) < 1e-9 and got[2] <= 270
    assert mixing.targets([("a", 0), (None, 0)]) == [0, 0] and mixing.targets([]) == []


def test_mixing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", "hot" if i % 3 else rng.choice(["a", "b", None, "é"])) for i in range(900)] + [(2000, None, "en", "a"), (2001, "", None, None), (5, "x y", "en", "b")]
    d = documents(spark, tmp_path, rows, "target")
    columns = ("doc_id", "size", "source_size", "target", "taken")
    got, again = (sorted(map(tuple, mixing.op3_mixing(spark, d).select(*columns).collect())) for _ in range(2))
    assert got == again and len(got) == len(rows)
    size = {(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[3] for r in rows}
    total, taken, target = collections.Counter(), collections.Counter(), {}
    for doc, n, source_size, goal, words in got:
        s = size[doc, n]
        total[s] += n
        taken[s] += words
        target[s] = goal
        assert 0 <= words <= 3 * n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    assert [round(target[s], 6) for s in order] == [round(t, 6) for t in mixing.targets([(s, total[s]) for s in order])]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order) and sum(taken.values()) == sum(total.values())
    mixed = mixing.mix(spark.read.parquet(f"{d}/documents.parquet").filter("doc_id <> 5"))
    assert mixed.columns[-1] == "target" and mixed.count() > 0


def test_mixing_is_as_word_by_word_queueing(spark, tmp_path):
    """All words of all passes, sorted by virtual time and cut at the budget; null and shared ids, equal rows, a long text."""
    rng = random.Random(9)
    rows = [(i % 50 if i % 4 else None, prose(rng, rng.randint(0, 40)), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(7, "w " * 20_000, "en", "b"), (None, None, None, "a"), (None, "", "en", None)] + [(None, "same row here", "en", "c")] * 300 + [(900, "x y", "en", "e")]
    docs = spark.read.parquet(f"{documents(spark, tmp_path, rows, 'finish')}/documents.parquet")
    for budget in (None, 9000):
        plan = mixing.plan(docs, budget=budget).collect()
        assert len(plan) == len(rows) and sum(r.doc_id is None for r in plan) == sum(r[0] is None for r in rows)
        words = []
        for k, r in enumerate(plan):
            if r["size"] and r.target:
                assert r.finish == r.sent / r.target
                for e in range(3):
                    words += [((e * r.source_size + r.sent - r["size"] + w + 1) / r.goal, k) for w in range(r["size"])]
        words.sort()
        want = collections.Counter(k for _, k in words[: sum({r.source: r.goal for r in plan}.values())])
        assert {k: r.taken for k, r in enumerate(plan) if r.taken} == want
        taken = collections.Counter()
        for r in plan:
            taken[r.source] += r.taken
        assert all(abs(taken[r.source] - r.target) <= 1 for r in plan)
        if budget is None:
            assert sum(taken.values()) == sum(r["size"] for r in plan)
            times = [(r.time, r.words) for r in mixing.queue(docs).collect()]
            assert times == sorted(times, key=lambda x: x[0]) and sum(n for _, n in times) == sum(taken.values())


def test_equal_rows_are_written_out_by_several_tasks(spark):
    docs = spark.range(40_000).selectExpr("cast(null as long) AS doc_id", "'same words here' AS text", "'s' AS source")
    docs = docs.unionByName(spark.createDataFrame([(1, "other words", "t")], "doc_id long, text string, source string"))
    plan = mixing.plan(docs)
    rows = plan.filter("doc_id IS NULL")
    assert tuple(rows.selectExpr("count(*)", "count(DISTINCT nth)", "count(DISTINCT sent)", "max(nth)").first()) == (40_000, 40_000, 40_000, 40_000)
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 40_000
    mixed = mixing.mix(docs)
    assert mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == plan.agg(F.sum("taken")).first()[0] == 120_002


def test_sharding(spark, tmp_path):
    rng = random.Random(3)
    rows = some_rows(6) + [(600 + i, prose(rng, 100)) for i in range(400)] + [(2000 + i, "copy " * 40) for i in range(330)]
    d = documents(spark, tmp_path, rows, "shard")
    got = sharding.op10_sharding(spark, d).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted((False, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert (r.law, r.grown_shard) == ("bytes", None)
    load = {s: sum(r.size for r in v) for s, v in by.items() if s is not None}
    assert sorted(load) == list(range(8)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    largest = max(r.size for r in got)
    rest = (sum(load.values()) - max(load.values())) / 7  # one document is larger than a shard's share
    assert max(load.values()) <= 1.2 * largest and max(sorted(load.values())[:-1]) - min(load.values()) <= 0.25 * rest
    copies = {r.shard for r in got if r.doc_id is not None and r.doc_id >= 2000}
    assert len(copies) <= 4  # more than a shard's worth, so more than one, but few
    small = collections.defaultdict(set)
    for r in got:
        if r.doc_id is not None and (r.doc_id < 7 or 100 <= r.doc_id < 120):
            small[r.text_crc32].add(r.shard)
    assert sum(len(v) > 1 for v in small.values()) <= 1


def test_mix_takes_each_row_for_itself(spark, tmp_path):
    """Rows without a doc_id, rows that share one, and equal rows, against what the plan takes of each text."""
    rng = random.Random(5)
    rows = [(i % 40 if i % 3 else None, f"{i} " + prose(rng, rng.randint(5, 60)), "en", "abc"[i % 3 - i % 2]) for i in range(300)]
    rows += rows[:6] * 2 + [(1, "x y z", None, "b"), (1, "x y z", "b", None)]
    docs = spark.read.parquet(f"{documents(spark, tmp_path, rows)}/documents.parquet")
    mixed = [collections.Counter(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5)]
    assert mixed[0] == mixed[1] and sum(r[0] is None for r in mixed[0]) > 20
    words = lambda n: sum(len(r[1].split()) * k for r, k in n.items())
    assert words(mixed[0]) == sum(len(r[1].split()) for r in rows) == sum(r.taken for r in mixing.plan(docs).collect())
    assert max(mixed[0].values()) <= 3 * max(collections.Counter(rows).values())
    for r in mixed[0]:  # texts in part are the first words of one
        assert r[4] == len(r[1]) and any(t[0] == r[0] and t[1].startswith(r[1]) for t in rows)


@pytest.mark.parametrize("hot", [0, 1100])
def test_sharding_of_a_table_that_is_nearly_all_copies(spark, tmp_path, hot):
    """Groups of 2, 5 and 20 copies of equal size, 10 rows without a copy, and a group that holds a third of all rows."""
    texts = [f"{k:08d} " * 20 for k in range(400)]
    sizes = [(2, 5, 20)[k % 3] for k in range(250)] + [1] * 10 + [hot]
    rows = list(enumerate(t for t, n in zip(texts, sizes) for _ in range(n)))
    got = sharding.op10_sharding(spark, documents(spark, tmp_path, rows, "shard")).collect()
    assert len(got) == len(rows)
    load, held = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in got:
        load[r.shard] += r.size
        held[r.text_crc32][r.shard] += 1
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 8
    pairs = lambda n: n * (n - 1) // 2
    whole = sum(pairs(sum(v.values())) for v in held.values() if sum(v.values()) <= 20)
    together = sum(pairs(n) for v in held.values() if sum(v.values()) <= 20 for n in v.values())
    assert together >= 0.97 * whole
    assert not hot or sorted(len(v) for v in held.values())[-1] == 3


def test_full_shards_swap():
    assert sharding.grants([[0, 5], [5, 0]], [0, 0]) == [1, 1]
    assert sharding.grants([[0, 10], [5, 0]], [0, 0]) == [1, 0.5]
    assert sharding.grants([[0, 10], [0, 0]], [0, -1]) == [0, 0]


def test_empty_tables(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "x")])
    none = f"{tmp_path}/none"
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{none}/documents.parquet")
    for query in (bpe.op4_bpe, langid.op2_langid, mixing.op3_mixing, sharding.op10_sharding):
        assert query(spark, none).collect() == []


def test_pipeline(spark, tmp_path):
    """The stages one after the other are what run() gives, and each decision takes effect."""
    docs = languages(4, 240)
    rows = [(i, t, k, "ab"[i % 2]) for i, t, k in docs] + [(500 + i, docs[i][1], docs[i][2], "a") for i in range(30)] + [(700, "Щука плыла по реке", None, "a"), (701, None, "aa", "a"), (702, docs[1][1] + " x@y.org 4337166598464399", "bb", "b")]
    d = documents(spark, tmp_path, rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    cols, df = spark.read.parquet(f"{d}/documents.parquet").columns, spark.read.parquet(f"{d}/documents.parquet")
    held = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, d)
        df.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        held.append(df)
        assert k == 4 or df.columns == cols
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in held]
    assert {r[0] for r in rows} - ids[0] == {700, 701}
    comp = {r.doc_id: r.component_id for r in simhash.components(held[0]).collect()}
    assert ids[1] == {i for i, c in comp.items() if i == c} and not any(i in ids[1] for i in range(500, 530)) and ids[2] == ids[1]
    assert not any("x@y.org" in r.text or "4337166598464399" in r.text for r in held[2].collect())
    copies = collections.Counter(r.doc_id for r in held[3].select("doc_id").collect())
    assert copies == {r.doc_id: -(-r.taken // r["size"]) for r in mixing.plan(held[2]).collect() if r.taken}
    tok = bpe.PairIndexBPE(open(bpe.default_path(), "rb").read())
    texts = {r.doc_id: r.text for r in held[2].collect()}
    parts = 0
    for r in held[4].collect():  # whole texts, but for the copy in which a source's share ends
        text = tok.decode(np.array(r.token_ids))
        assert r.n_tokens == len(r.token_ids) and texts[r.doc_id].startswith(text)
        parts += text != texts[r.doc_id]
    assert parts <= 2
    got = collections.Counter((r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, d).collect())
    assert got == collections.Counter((r.doc_id, tuple(r.token_ids)) for r in held[4].collect())
