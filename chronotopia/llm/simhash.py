"""SimHash near-duplicates: 64-bit fingerprints joined through deletion-variant signatures.

A fingerprint is cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in at most 4 bits, one
segment differs in at most one bit (4 < 2 * 3), so the two agree on that segment with one bit position wildcarded.
Every fingerprint is therefore indexed under 64 one-wildcard variants (one for each bit), an equality on
(wildcard position, rest of the segment) proposes pairs, and the whole Hamming distance verifies them. No link within
4 bits is lost, and none beyond is made.

Edge cases: a null or blank text has fingerprint zero and links like any other; equal fingerprints are one node, so
repeated rows cost nothing; rows with a null doc_id get a fingerprint and the component of that fingerprint.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, KEY, checkpointed, connected_components, join_hot, local_roots, own_names, row_key, small_batches, table

SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: A signature's members beyond this are dealt in blocks, and pairs of blocks go to tasks of their own.
BLOCK = 2048
#: Links that a task holds before it folds them into stars, or twice the stars if those are more.
FOLD = 250_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the shingles' XXH64 bits; shingles of ASCII-lower-cased words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    ends = list(accumulate(map(len, words)))
    starts = [0] + [e + i + 1 for i, e in enumerate(ends[:-1])]
    hashes = [digest(joined[s : e + k], seed) for k, s, e in zip(range(shingle - 1, len(words)), starts, ends[shingle - 1 :])]
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keyed: bool = False) -> DataFrame:
    """(doc_id, fp long) for every row, and the row's key if ``keyed``."""
    names = ["doc_id", *(KEY if keyed else ())]

    def run(batches):
        for b in batches:
            texts = b.column("text")
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(fps.view(np.int64), pa.int64())], [*names, "fp"])

    key = row_key(docs) if keyed else []
    ids = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def _linked(key: np.ndarray, left: np.ndarray, fp: np.ndarray, distance: int):
    """Verified pairs among rows of equal key, in pieces. left: True for rows of the first block, of two."""
    order = np.argsort(key, kind="stable")
    key, fp, left = key[order], fp[order].view(np.uint64), left[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for at, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        own, first = fp[at : at + n], left[at : at + n]
        for i in range(0, n, 512):
            near = np.bitwise_count(own[i : i + 512, None] ^ own[None, :]) <= distance
            r, c = np.nonzero(near & (first[i : i + 512, None] | first[None, :]))
            keep = r + i < c
            yield own[r[keep] + i], own[c[keep]]
    small = (sizes > 1) & (sizes <= 64)
    starts, sizes = starts[small], sizes[small]
    for gap in range(1, int(sizes.max()) if len(sizes) else 1):  # all pairs at this distance in their groups, at once
        starts, sizes = starts[sizes > gap], sizes[sizes > gap]
        reps = sizes - gap
        i = np.repeat(starts - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
        near = (np.bitwise_count(fp[i] ^ fp[i + gap]) <= distance) & (left[i] | left[i + gap])
        yield fp[i[near]], fp[i[near] + gap]


def _edges_of(rows, distance: int, block: int, blocks: bool):
    """One partition of (key, fp[, tile columns]) to star edges, and the members of signatures that are too large."""
    batches = [b for b in rows if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    key, fp = (t.column(c).to_numpy() for c in ("key", "fp"))
    left = t.column("left").to_numpy() if blocks else np.ones(len(key), bool)
    out = {"key": [], "a": [], "b": []}
    if not blocks:
        _, back, sizes = np.unique(key, return_inverse=True, return_counts=True)
        sizes = sizes[back]
        big = sizes > block
        out = {"key": [key[big]], "a": [fp[big]], "b": [sizes[big]]}
        key, fp, left = key[~big], fp[~big], left[~big]
    a, b, held, most = [], [], 0, FOLD
    for x, y in _linked(key, left, fp, distance):
        a.append(x)
        b.append(y)
        held += len(x)
        if held > most:  # fold into stars, so that memory stays within the number of nodes
            x, y = (z.view(np.int64) for z in local_roots(np.concatenate(a), np.concatenate(b)))
            a, b, held, most = [x.view(np.uint64)], [y.view(np.uint64)], len(x), max(FOLD, 2 * len(x))
    if a and sum(map(len, a)):
        x, y = local_roots(np.concatenate(a), np.concatenate(b))
        x, y = x[x != y], y[x != y]
        out["key"].append(np.full(len(x), -1))
        out["a"].append(x.view(np.int64))
        out["b"].append(y.view(np.int64))
    if out["key"]:
        cols = [pa.array(np.concatenate(out[c]).astype(np.int64)) for c in ("key", "a", "b")]
        yield pa.RecordBatch.from_arrays(cols, ["key", "a", "b"])


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Star edges (a, b) that connect what links of at most ``distance`` bits connect; ``fps`` has distinct ``fp``."""
    if distance >= 2 * len(SEGMENTS):
        raise ValueError("so many differing bits need more segments")
    variants = []
    for n, (at, width) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        variants += [segment.bitwiseAND(F.lit(~(1 << w) & ((1 << width) - 1))).bitwiseOR(F.lit((at + w) << 32)) for w in range(width)]
    # Each fingerprint becomes 64 rows, so they are dealt out again before.
    rows = fps.repartition("fp").select("fp", F.explode(F.array(*variants)).alias("key")).repartition("key")
    found = checkpointed(rows.mapInArrow(lambda it: _edges_of(it, distance, block, False), "key long, a long, b long"))
    edges = found.filter("key = -1").select("a", "b")
    # Signatures with more members than a block: every pair of their blocks is a unit of its own.
    count = F.ceil(F.col("b") / block).cast("int")
    tile = F.pmod(F.xxhash64("a"), count).cast("int")
    big = found.filter("key <> -1").select("key", F.col("a").alias("fp"), tile.alias("own"), count.alias("n"))
    big = big.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    big = big.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp",
        (F.col("own") <= F.col("other")).alias("left"),
    )
    return edges.union(
        big.repartition("key").mapInArrow(lambda it: _edges_of(it, distance, block, True), "key long, a long, b long").select("a", "b")
    )


def _least(rows: DataFrame, value: Column, distance: int) -> tuple[DataFrame, DataFrame, int]:
    """(fp, root, equal) for every ``fp`` of ``rows``, equal counting its rows; (root, least, _n), the least ``value`` of what links reach; number of fps."""
    fps = checkpointed(rows.groupBy("fp").agg(F.min(value).alias("least"), F.count("*").alias("equal")))
    roots = connected_components(links(fps.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.select("fp", "root", "equal"), named.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("_n")), fps.count()


def components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id that links reach."""
    rows = checkpointed(with_fingerprints(docs))
    named, least, total = _least(rows, F.col("doc_id"), distance)
    of = join_hot(named, least.withColumnRenamed("least", "component_id"), "root", total).select("fp", "component_id", F.col("equal").alias("_n"))
    return join_hot(rows, of, "fp", rows.count()).select("doc_id", "fp", "component_id")


@own_names("doc_id", "text")
def near_dedup(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` of each component: that of the smallest doc_id; null is the largest, and of equals the row's key decides."""
    rows = checkpointed(with_fingerprints(docs, keyed=True))
    _, least, _ = _least(rows, F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *KEY), distance)
    keep = checkpointed(least.select(*[F.col(f"least.{k}").alias(k) for k in KEY]))
    # Rows that are equal in great number stay where they are until one of them is left; there are at most HOT such rows.
    many = F.broadcast(checkpointed(rows.groupBy(*KEY).count().filter(F.col("count") > max(1, rows.count() // HOT)).select(*KEY)))
    keyed = docs.select("*", *row_key(docs))
    few = keyed.join(many, [*KEY], "left_anti").join(keep, [*KEY], "left_semi").dropDuplicates([*KEY])
    hot = keyed.join(F.broadcast(keep.join(many, [*KEY], "left_semi")), [*KEY], "left_semi").dropDuplicates([*KEY])
    return few.union(hot).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component of near-duplicates."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
