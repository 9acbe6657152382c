"""Sharding by balanced label propagation: linked documents gather in a shard, and shards stay even in bytes.

Documents are linked through a hub (here: equal texts). Hubs of 2 % of a shard's bytes or documents are placed first, largest first, each
whole in the emptiest shard, or in as few shards as have room for it. Documents of all other hubs begin in a shard by hash,
and in each round a hub's counts by shard are joined back to its documents, each of which asks to move to the hub's fullest
shard. Requests are granted, by a hash, up to the room that a shard has and what leaves it in the same round, so full shards
swap. When nothing is asked for, or what is asked for no longer falls, the hubs that are still cut, and those above a shard's
share, are dealt whole. Then documents without links, which cut nothing, fill every shard to its share: the largest to the
emptiest, then along a hashed order in two classes of size, so that small ones even out what large ones leave.

The law is ``bytes``: shards' sizes are near equal. Only 8 x 8 sums go to the driver in a round, and the large hubs once.
Counts and running sums are taken by (shard, hash bin), so no shard is gathered in one task; a hub that is not large (at most 0.25 % of
all rows) may be, and the rows of large ones stay where they are when hubs are joined.

Edge cases: a null text has size 1 (none, plus 1), checksum 0 and no link; empty texts link with each other; rows that
share doc_id are told apart by size and checksum, and equal rows get different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, join_hot, running_sum, table

SHARDS, BINS = 8, 4096
#: Rounds go on while the bytes that are asked to move fall to this part; what is cut then is dealt whole.
FALLING = 0.9
#: Documents without links are dealt by falling size: from 2 % of a shard one by one, from 0.2 %, the rest.
LARGE, CLASSES = 0.02, (0.002, 0.0)


def _hash(seed: int, *cols: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 1)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 63 - (BINS.bit_length() - 1)).cast("int")


def _pick(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int"))


def _loads(df: DataFrame, shards: int) -> list[float]:
    load = [0.0] * shards
    for r in df.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        load[r["shard"]] = float(r["n"])
    return load


def place_large(linked: DataFrame, large: list[tuple[str, int, int]], load: list[float], capacity: float) -> DataFrame:
    """``linked`` with ``shard``, for the hubs ``large`` (hub, bytes, documents, all of one size); adds to ``load``."""
    rows = []
    for hub, size, count in sorted(large, key=lambda x: (-x[1], x[0])):
        each, at = size / count, 0
        while at < count:
            to = min(range(len(load)), key=lambda k: (load[k], k))
            n = min(count - at, max(1, int((capacity - load[to]) / each + 1e-9)))
            load[to] += n * each
            rows.append((hub, at, at := at + n, to))
    parts = linked.sparkSession.createDataFrame(rows, "hub string, low long, high long, shard int")
    whole = parts.groupBy("hub").agg(F.count("*").alias("parts"), F.max("shard").alias("shard"))
    one = linked.join(F.broadcast(whole.filter("parts = 1")), "hub").select("hub", "doc_id", "size", "crc", "shard")
    cut = linked.join(F.broadcast(whole.filter("parts > 1").select("hub")), "hub").withColumn("h", _hash(7, "doc_id", "crc"))
    cut = running_sum(cut.withColumn("bin", _bin(F.col("h"))), ["hub"], "bin", [F.col("h"), F.col("doc_id")], F.lit(1), "nth")
    cut = cut.alias("l").join(F.broadcast(parts.alias("r")), F.expr("l.hub = r.hub AND l.nth > r.low AND l.nth <= r.high"))
    return one.union(cut.select("l.hub", "doc_id", "size", "crc", "shard"))


def grants(flow: list[list[float]], room: list[float]) -> list[float]:
    """Part of the requests to each shard that fits its room and what leaves it by the same grants; flow[from][to]."""
    n = len(room)
    inward = [sum(flow[s][t] for s in range(n)) for t in range(n)]
    grant = [1.0] * n
    while True:
        fits = [room[t] + sum(flow[t][s] * grant[s] for s in range(n)) for t in range(n)]
        new = [min(grant[t], max(0.0, fits[t] / inward[t])) if inward[t] else 0.0 for t in range(n)]
        if max(x - y for x, y in zip(grant, new)) < 1e-3:
            return new
        grant = new


def propagate(linked: DataFrame, room: list[float]) -> DataFrame:
    """``linked`` (hub, doc_id, size, crc) with ``shard``; shard k gets about ``room[k]`` at most, and hubs may still be cut."""
    shards, all_ = len(room), sum(room) or 1.0
    unit = _hash(11, "doc_id", "crc") / float(1 << 63)
    start = sum((F.when(unit >= sum(room[: k + 1]) / all_, 1).otherwise(0) for k in range(shards - 1)), F.lit(0)).cast("int")
    own, before, turn = checkpointed(linked.withColumn("shard", start)), None, 0
    while True:
        by = own.groupBy("hub").agg(*[F.sum((F.col("shard") == k).cast("long")).alias(f"n{k}") for k in range(shards)])
        # The fullest shard; of equals, one by the hub's hash.
        ask = F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(1 << 30)).alias("t"), F.lit(k).alias("k")) for k in range(shards)])
        found = own.join(by.select("hub", F.array_max(ask)["k"].cast("int").alias("to")), "hub")
        found = checkpointed(found.select("hub", "doc_id", "size", "crc", "shard", "to"))
        load, flow = _loads(found, shards), [[0.0] * shards for _ in range(shards)]
        for r in found.filter("shard <> to").groupBy("shard", "to").agg(F.sum("size").alias("n")).collect():
            flow[r["shard"]][r["to"]] = float(r["n"])
        asked = sum(map(sum, flow))
        if not asked or (before is not None and asked > FALLING * before):
            return found.select("hub", "doc_id", "size", "crc", "shard")
        before, grant = asked, grants(flow, [room[k] - load[k] for k in range(shards)])
        unit = _hash(100 + turn, "doc_id", "crc") / float(1 << 63)
        moved = F.when((F.col("to") != F.col("shard")) & (unit < _pick(grant, F.col("to"))), F.col("to")).otherwise(F.col("shard"))
        own, turn = found.select("hub", "doc_id", "size", "crc", moved.cast("int").alias("shard")), turn + 1


def settle(own: DataFrame, load: list[float], capacity: float) -> DataFrame:
    """``own`` with every hub in one shard: hubs that are cut or above their shard's share are dealt whole; adds to ``load``."""
    hubs = own.groupBy("hub").agg(F.sum("size").alias("size"), F.min("shard").alias("shard"), F.max("shard").alias("last"))
    h = _hash(9, "hub")
    hubs = checkpointed(hubs.withColumn("h", h).withColumn("bin", _bin(h)))
    whole = running_sum(hubs.filter("shard = last"), ["shard"], "bin", [F.col("h"), F.col("hub")], F.col("size"), "sum")
    room = _pick([capacity - x for x in load], F.col("shard"))
    whole = checkpointed(whole.select("hub", "size", "shard", (F.col("sum") <= room).alias("fits")))
    kept = whole.filter("fits").select("hub", "size", "shard")
    for k, x in enumerate(_loads(kept, len(load))):
        load[k] += x
    rest = hubs.filter("shard < last").select("hub", "size").union(whole.filter("NOT fits").select("hub", "size"))
    to = kept.select("hub", "shard").union(deal(rest, ["hub"], load, capacity).select("hub", "shard"))
    return own.drop("shard").join(to, "hub").select("hub", "doc_id", "size", "crc", "shard")


def gather(linked: DataFrame, load: list[float], capacity: float, rows: int) -> DataFrame:
    """``linked`` (hub, doc_id, size, crc), of ``rows`` rows in all, with ``shard``; adds to ``load``, and no shard gets more than about ``capacity``."""
    hubs = linked.groupBy("hub").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
    hubs = hubs.filter((F.col("n") >= LARGE * capacity) | (F.col("docs") >= LARGE * rows / len(load)))
    large = [(r["hub"], r["n"], r["docs"]) for r in hubs.collect()]
    if not large:
        return settle(propagate(linked, [capacity - x for x in load]), load, capacity)
    first = place_large(linked, large, load, capacity)
    named = linked.sparkSession.createDataFrame([(x[0],) for x in large], "hub string")
    small = linked.join(F.broadcast(named), "hub", "left_anti")
    return first.union(settle(propagate(small, [max(0.0, capacity - x) for x in load]), load, capacity))


def deal(items: DataFrame, keys: list[str], load: list[float], capacity: float) -> DataFrame:
    """``items`` (keys, size) of less than LARGE of a shard with ``shard``: along a hashed order, each shard up to its share."""
    h = _hash(5, *keys)
    items = checkpointed(items.withColumn("h", h).withColumn("bin", _bin(h)).withColumn("one", F.lit(0)))
    done, bound = [], float("inf")
    for share in CLASSES:
        own = items.filter((F.col("size") >= share * capacity) & (F.col("size") < bound))
        bound = share * capacity
        own = running_sum(own, ["one"], "bin", [F.col("h"), *map(F.col, keys), F.col("size")], F.col("size"), "sum")
        size = own.agg(F.max("sum")).first()[0]
        if size is None:
            continue
        # What is left to each shard, if all that remains were dealt out; this class takes its part of that.
        left = [max(0.0, capacity - x) for x in load]
        rest = sum(left) or 1.0
        at, edges = 0.0, []
        for x in left:
            at += x * float(size) / rest
            edges.append(at)
        middle = F.col("sum") - F.col("size") / 2
        shard = sum((F.when(middle > e, 1).otherwise(0) for e in edges[:-1]), F.lit(0)).cast("int")
        own = checkpointed(own.select(*keys, "size", shard.alias("shard")))
        for k, x in enumerate(_loads(own, len(load))):
            load[k] += x
        done.append(own)
    if not done:
        return items.select(*keys, "size", F.lit(0).alias("shard"))
    return done[0] if len(done) == 1 else done[0].union(done[1])


def fill(free: DataFrame, load: list[float], capacity: float) -> DataFrame:
    """``free`` (doc_id, size, crc) with ``shard``, each shard up to its share.

    There are at most shards / LARGE documents of LARGE of a shard each: those go, largest first, to the emptiest.
    """
    large = sorted((-r["size"], r["crc"], r["doc_id"] is None, r["doc_id"] or 0) for r in free.filter(F.col("size") >= LARGE * capacity).collect())
    rows = []
    for size, crc, unknown, doc in large:
        to = min(range(len(load)), key=lambda k: (load[k], k))
        load[to] -= size
        rows.append((None if unknown else doc, -size, crc, to))
    done = free.sparkSession.createDataFrame(rows, "doc_id long, size long, crc long, shard int")
    small = deal(free.filter(F.col("size") < LARGE * capacity), ["doc_id", "crc"], load, capacity)
    return done.union(small.select("doc_id", "size", "crc", "shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; documents of equal text are linked."""
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("crc"), F.md5(text.cast("binary")).alias("hub")))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    capacity, load = float(total or 0) / shards, [0.0] * shards
    hubs = rows.filter("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("_n"), F.lit(True).alias("linked")).filter("_n > 1")
    tagged = checkpointed(join_hot(rows.filter("hub IS NOT NULL"), hubs, "hub", count, "left").select("hub", "doc_id", "size", "crc", "linked"))
    linked = gather(tagged.filter("linked").drop("linked"), load, capacity, count)
    free = tagged.filter("linked IS NULL").select("doc_id", "size", "crc").union(rows.filter("hub IS NULL").select("doc_id", "size", "crc"))
    placed = linked.select("doc_id", "size", "crc", "shard").union(fill(free, load, capacity))
    h = _hash(3, "doc_id", "crc")
    placed = checkpointed(placed.withColumn("h", h).withColumn("bin", _bin(h)))
    slots = running_sum(placed, ["shard"], "bin", [F.col("h"), F.col("doc_id"), F.col("crc")], F.lit(1), "slot")
    return slots.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return shard(table(spark, sf_dir, "documents"))
