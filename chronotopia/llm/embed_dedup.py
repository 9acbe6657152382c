"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut in steps of ``width``; ``hashes`` steps
together name a bucket, in each of ``tables`` tables. Vectors of one label that share a bucket are compared exactly
(cosine in double precision). At cosine 0.93, the edge, two vectors share a bucket in some table with probability
0.993; at 0.96 with 0.9998.

Equal vectors of a label are one node that carries its number. First only numbers meet in buckets: a node, and 64 signs of
other projections of its vector; nodes with another of the bucket at a distance of signs that a near one may have (one
near pair in some millions has a larger one) stay in it. So most nodes that meet by chance are gone before vectors
are sent. A pair that shares several buckets counts only in the first table where it does, which both vectors' signatures
tell, so links can be counted without listing pairs. Large buckets are dealt in blocks, and pairs of blocks are units of
their own; a unit gives one row for each vector with a link: its count, and the smallest node that it reaches there.

Edge cases: vectors that are null, zero or hold null or non-finite components, and those with a null label or vec_id,
link with nothing and stay; vectors of different length are never compared; repeated rows count as vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, join_hot, local_roots, table
from .vectors import unit, usable

COSINE, TABLES, HASHES, WIDTH, BLOCK = 0.93, 32, 12, 2.0, 1024


def signatures(x: np.ndarray, tables: int, hashes: int, width: float, seed: int = 1) -> np.ndarray:
    """Bucket (32 bits) of each row in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * hashes))
    shift = rng.uniform(0, width, tables * hashes)
    steps = np.floor((unit(x) @ a + shift) / width).astype(np.int64).reshape(len(x), tables, hashes)
    mixed = np.full((len(x), tables), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(hashes):
        mixed = (mixed ^ steps[:, :, k].view(np.uint64)) * np.uint64(0x100000001B3)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signs(x: np.ndarray, seed: int = 2) -> np.ndarray:
    """64 signs of random projections of each row."""
    a = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], 64))
    return np.packbits(unit(x) @ a > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def most_signs(cosine: float) -> int:
    """Signs by which a pair of this cosine differs at most, but for a chance of some 10^-7."""
    p = float(np.arccos(cosine) / np.pi)
    return int(np.ceil(64 * p + 5.6 * np.sqrt(64 * p * (1 - p))))


def _near(batches, most: int, block: int):
    """One partition of (key, t, node, signs) to (key, t, node, size): nodes that may have a near one in their bucket."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    order = np.argsort(t.column("key").to_numpy(), kind="stable")
    key, tt, node, sign = (t.column(c).to_numpy()[order] for c in ("key", "t", "node", "signs"))
    sign = sign.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    stay = (sizes > block)[bucket]  # so large a bucket is passed on whole
    for at, n in zip(starts[(sizes > 64) & (sizes <= block)], sizes[(sizes > 64) & (sizes <= block)]):
        own = sign[at : at + n]
        for i in range(0, n, 256):
            stay[at + i : at + min(n, i + 256)] = (np.bitwise_count(own[i : i + 256, None] ^ own[None, :]) <= most).sum(axis=1) > 1
    few = (sizes > 1) & (sizes <= 64)
    starts, rest = starts[few], sizes[few]
    for gap in range(1, int(rest.max()) if len(rest) else 1):
        starts, rest = starts[rest > gap], rest[rest > gap]
        reps = rest - gap
        i = np.repeat(starts - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
        i = i[np.bitwise_count(sign[i] ^ sign[i + gap]) <= most]
        stay[i] = stay[i + gap] = True
    size = np.bincount(bucket, stay, len(sizes)).astype(np.int64)[bucket]
    cols = [key[stay], tt[stay].astype(np.int32), node[stay], size[stay]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "t", "node", "size"])


def _pairs(key: np.ndarray):
    """Pairs of rows with equal key (sorted), in pieces."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for at, n in zip(starts[sizes > 48], sizes[sizes > 48]):
        for i in range(0, n, 128):
            r, c = np.nonzero(np.arange(n)[None, :] > np.arange(i, min(n, i + 128))[:, None])
            yield at + i + r, at + c
    small = (sizes > 1) & (sizes <= 48)
    starts, sizes = starts[small], sizes[small]
    for gap in range(1, int(sizes.max()) if len(sizes) else 1):
        starts, sizes = starts[sizes > gap], sizes[sizes > gap]
        reps = sizes - gap
        i = np.repeat(starts - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
        for at in range(0, len(i), 200_000):
            yield i[at : at + 200_000], i[at : at + 200_000] + gap


def _verify(batches, cosine: float, tables: int):
    """One partition of (key, t, side, node, n, label, sig, embedding) to (node, root, links)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    order = np.argsort(t.column("key").to_numpy(), kind="stable")
    cols = {c: t.column(c).to_numpy()[order] for c in ("key", "t", "side", "node", "n", "label", "dim")}
    sig = np.frombuffer(b"".join(x.as_py() for x in t.column("sig")), np.int32).reshape(-1, tables)[order]
    flat = t.column("embedding").combine_chunks()
    values, begin = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(t.column("dim").to_numpy())]
    a, b, counts, held = [], [], {}, 0
    for dim in np.unique(cols["dim"]).tolist():
        own = np.flatnonzero(cols["dim"] == dim)
        x = unit(values[begin[order[own]][:, None] + np.arange(dim)])
        key, side, label, tt, s = (v[own] for v in (cols["key"], cols["side"], cols["label"], cols["t"], sig))
        node, n = cols["node"][own], cols["n"][own]
        links = np.zeros(len(own), np.int64)
        for i, j in _pairs(key):
            ok = ((side[i] == 2) | (side[i] != side[j])) & (label[i] == label[j]) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            ok = (s[i] == s[j]).argmax(axis=1) == tt[i]  # the first table in which they meet
            i, j = i[ok], j[ok]
            links += np.bincount(i, n[j], len(own)).astype(np.int64) + np.bincount(j, n[i], len(own)).astype(np.int64)
            a.append(node[i])
            b.append(node[j])
            held += len(i)
            if held > 1_000_000:
                x_, y_ = local_roots(np.concatenate(a), np.concatenate(b))
                a, b, held = [x_], [y_], len(x_)
        some = links > 0
        ids, back = np.unique(node[some], return_inverse=True)
        for k, v in zip(ids.tolist(), np.bincount(back, links[some]).astype(np.int64).tolist() if len(ids) else []):
            counts[k] = counts.get(k, 0) + v
    if counts:
        nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
        n = np.array([counts[k] for k in nodes.tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(n)], ["node", "root", "links"])


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    ok = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    same = [F.xxhash64(F.lit(seed), "label", "embedding").alias(name) for seed, name in ((21, "ha"), (22, "hb"))]
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    ids = checkpointed(src.select("vec_id", ok.alias("ok"), *same))
    nodes = src.filter(ok).select("vec_id", "label", "embedding", *same).groupBy("ha", "hb").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"), F.xxhash64(F.first("label")).alias("label")
    )
    held = ["ha", "hb", "least_id", "n", "label", "embedding"]

    def hashed(batches):
        for b in batches:
            dims = np.diff(b.column("embedding").offsets.to_numpy())
            values, sig = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64), [b""] * b.num_rows
            begin, sign = np.r_[0, np.cumsum(dims)], np.zeros(b.num_rows, np.uint64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = values[begin[own][:, None] + np.arange(dim)]
                sign[own] = signs(x)
                for k, row in zip(own.tolist(), signatures(x, tables, hashes, width)):
                    sig[k] = row.tobytes()
            more = [pa.array(dims.astype(np.int32)), pa.array(sig, pa.binary()), pa.array(sign.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*map(b.column, held), *more], [*held, "dim", "sig", "signs"])

    kind = src.schema["embedding"].dataType.simpleString()
    nodes = nodes.mapInArrow(hashed, f"ha long, hb long, least_id long, n long, label long, embedding {kind}, dim int, sig binary, signs long")
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring(F.col("sig"), t * 4 + 1, F.lit(4)))).alias("t", "bucket")
    entries = nodes.select("node", "signs", "label", "dim", at).select(F.xxhash64("label", "dim", "t", "bucket").alias("key"), F.col("t").cast("byte").alias("t"), "node", "signs")
    near = lambda it: _near(it, most_signs(cosine), 2 * block)
    met = entries.repartition("key").mapInArrow(near, "key long, t int, node long, size long")
    blocks = F.ceil(F.col("size") / block).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    met = met.select("node", "t", side.alias("side"), F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    units = met.join(nodes.select("node", "n", "label", "dim", "sig", "embedding"), "node").repartition("key")
    found = checkpointed(units.mapInArrow(lambda it: _verify(it, cosine, tables), "node long, root long, links long"))
    roots = connected_components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "ha", "hb", "least_id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    named = checkpointed(named)
    total = named.count()
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("_n"))
    of = join_hot(named, least, "root", total)
    of = of.select("ha", "hb", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("n").alias("_n"))
    linked = join_hot(ids.filter("ok").drop("ok"), of, ["ha", "hb"], ids.count()).select("vec_id", "n_links", "component_id")
    out = linked.union(ids.filter("NOT ok").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links, its component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for the query, by comparing all pairs of a label.
ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = r),
comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v LEFT JOIN comp ON comp.vec_id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.vec_id"""
