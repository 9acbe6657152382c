import numpy as np

from chronotopia.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def table(spark, path, x, labels, more=()):
    rows = [(i, [float(v) for v in r], int(k), "x") for i, (r, k) in enumerate(zip(x, labels))] + list(more)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


ODD = [(900, None, 1, "x"), (901, [0.0] * 16, 1, "x"), (902, [None] * 16, 1, "x"), (903, [float("nan")] + [1.0] * 15, 1, "x"), (904, [float("inf")] + [1.0] * 15, 1, "x"), (905, [1.0] * 3, 1, "x"), (None, [1.0] * 16, 1, "x")]


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((300, 16))
    x[200:260] = x[3] + 0.05 * rng.standard_normal((60, 16))
    x[260:280] = x[5]
    x[280] = 3 * x[5]
    return x.astype(np.float32).astype(float), np.r_[rng.integers(0, 3, 200), np.ones(100)].astype(int)


def test_near_duplicates_are_as_brute_force(spark, tmp_path):
    x, labels = vectors()
    d = table(spark, tmp_path, x, labels, [*ODD, (910, [1.0] * 16, None, "x")])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], 10**6).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    for df in (embed_dedup.op5_embed_dedup(spark, d), embed_dedup.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"), block=16)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}
        assert len(got) == len(x) + len(ODD) + 1
        for i in range(len(x)):
            assert got[i] == (near[i].sum(), comp[i], comp[i] == i)
        assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903, 904, 905, 910, None))


def exact(x, ids, number, k=20):
    """The k nearest of the row ``number``, best first."""
    score = x @ x[number]
    return [(int(ids[i]), score[i]) for i in np.lexsort((ids, -score)) if i != number][:k]


def test_search_finds_the_nearest(spark, tmp_path):
    x, labels = vectors(2)
    x[:50] *= np.linspace(0.2, 4, 50)[:, None]
    d = table(spark, tmp_path, x, labels, ODD)
    rows = ann.search(spark.read.parquet(f"{d}/embeddings.parquet"), rows_block=40, queries_block=8).collect()
    lost = 0
    x = np.float32(x).astype(float)
    for q in range(0, 300, 20):
        got = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q)
        want = exact(x, np.arange(300), q)
        assert [r for r, *_ in got] == list(range(1, 21)) and all(abs(s - x[i] @ x[q]) < 1e-9 for _, i, s in got)
        lost += len({i for i, _ in want} - {i for _, i, _ in got})
    assert lost <= 0.1 * 15 * 20
    assert {r.query_id for r in rows} == set(range(0, 300, 20))
    whole = ann.search(spark.read.parquet(f"{d}/embeddings.parquet"), share=1.0).collect()
    for q in range(0, 300, 20):
        assert [r.vec_id for r in sorted(whole, key=lambda r: r["rank"]) if r.query_id == q] == [i for i, _ in exact(x, np.arange(300), q)]


def test_search_keeps_repeated_ids_other_lengths_and_opposite_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((41, 8)).astype(np.float32).astype(float)
    x[:20] = -np.abs(x[:20])
    ids = np.r_[np.arange(38), 0, 0, 20]
    x[39] = x[38]
    more = [(40, [1.0, 2.0], 1, "x"), (41, [2.0, 1.0], 1, "x"), (60, [3.0], 1, "x")]
    spark.createDataFrame([(int(i), [float(v) for v in r], 1, "x") for i, r in zip(ids, x)] + more, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = ann.op7_ann(spark, str(tmp_path)).collect()
    want = sorted((int(ids[q]), k + 1, round(s, 9)) for q in np.flatnonzero(ids % 20 == 0) for k, (_, s) in enumerate(exact(x, ids, q)))
    assert sorted((r.query_id, r["rank"], round(r.score, 9)) for r in rows if r.query_id != 40) != [] and len(rows) == len(want) + 1
    assert [(r["rank"], r.vec_id, r.score) for r in rows if r.query_id == 40] == [(1, 41, 4.0)]
    assert {(r.query_id, r.vec_id) for r in rows} >= {(0, 0)} and 60 not in {r.query_id for r in rows}
    found = sorted((r.query_id, r["rank"], round(r.score, 9)) for r in rows if r.query_id != 40)
    assert len(set(found) & set(want)) >= 0.9 * len(set(want))


def test_few_and_no_vectors(spark, tmp_path):
    d = table(spark, tmp_path, np.eye(3), [0, 0, 1])
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.op7_ann(spark, d).collect()] == [(0, 1, 1), (0, 2, 2)]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert ann.op7_ann(spark, f"{tmp_path}/none").collect() == [] and embed_dedup.op5_embed_dedup(spark, f"{tmp_path}/none").collect() == []
