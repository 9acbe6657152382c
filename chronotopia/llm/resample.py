"""Importance resampling of documents towards a target corpus, by hashed n-gram features, with long texts cut in chunks.

Features are the runs of 1 to 3 consecutive words; each falls into one of 10,000 buckets. What a bucket is worth follows
from how much likelier it is in the target texts than in all documents; a document's weight is the sum over its features;
with Gumbel noise drawn from its id, the highest scores are a draw without replacement by those weights.

Overlap chunking: texts of over LONG bytes are cut near every LONG bytes, at word boundaries. A chunk carries the next
n-1 words too, so that every run which starts in it is whole, but owns only the starting positions before them. Chunks
are dealt out to all tasks, and their counts and weights are summed by document; short texts stay where they are read.
The counts of the buckets are summed in the task first: a shuffle gets at most 10,000 rows a task, and the gains, 10,000
numbers, go to the tasks as a broadcast whose size is fixed.

The draw needs a global order only of what can be drawn: rows are range-sorted by score, ranges are counted (a row each),
and a row's rank is its number in its range plus what lies before.

Edge cases: null and empty texts, and texts without words, have no features and weight 0. A null doc_id draws its noise as
an empty one. Equal scores go to the smaller doc_id, nulls last; rows that are equal in both are told apart by n_features
only, so that ranks of repeated rows are dealt among equals. An empty table gives no rows, and without target texts only
the documents' own counts matter. Only the columns named are read, so others may have any name. Rows of one long text are
told apart by their place in the table as read, so ``docs`` should be a stored table, not a random sample drawn on the fly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, table

#: Words of texts whose ASCII letters are small: bytes of other characters are all over 0x7F.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS, N = 10_000, 3
#: Bytes of a chunk's own part.
LONG = 1 << 18
#: Of the documents with at least LEAST_WORDS words, PERCENT in a hundred are drawn.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42


def chunks(text: bytes, long: int = 0, n: int = N) -> Iterator[tuple[bytes, int]]:
    """Pieces of a text of small letters, and how many bytes of each are its own; what follows are the next n-1 words."""
    long = long or LONG
    start = 0
    while len(text) - start > long:
        # The own part ends with the word that is met at or after its length.
        first = WORD.search(text, start + long - 1)
        if first is None:
            break
        own = stop = first.end()
        for _ in range(n - 1):
            if (word := WORD.search(text, stop)) is None:
                break
            stop = word.end()
        yield text[start:stop], own - start
        start = own
    yield text[start:], len(text) - start


def buckets(piece: bytes, own: int | None = None) -> tuple[int, np.ndarray]:
    """Words of a piece's own part, and the bucket of every run of words that starts there."""
    piece = piece.lower()
    words = WORD.findall(piece)
    mine = len(words) if own is None or own >= len(piece) else len(WORD.findall(piece[:own]))
    more = [b" " + w for w in words]
    # A run's checksum continues that of the run which is a word shorter.
    codes = list(map(crc32, words))
    runs, found = codes, [codes[:mine]]
    for k in range(1, N):
        runs = list(map(crc32, more[k:], runs))
        found.append(runs[:mine])
    return mine, np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found))) % BUCKETS


def pieces(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(k0.., piece, own, _row) of the texts that are one chunk, and of the chunks of all others, dealt out."""
    text = F.col("text").cast("string").cast("binary")
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], text.alias("piece"))
    is_long = F.coalesce(F.octet_length("piece") > LONG, F.lit(False))
    small_batches(docs)
    whole = src.filter(~is_long).select("*", F.lit(None).cast("int").alias("own"), F.lit(None).cast("long").alias("_row"))

    long = LONG

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                held = b.slice(i, 1)
                for piece, own in chunks(held.column("piece")[0].as_py().lower(), long):
                    cols = [*held.columns[: len(keep)], pa.array([piece], pa.binary()), pa.array([own], pa.int32()), held.column("_row")]
                    yield pa.RecordBatch.from_arrays(cols, names)

    names = whole.columns
    numbered = src.filter(is_long).withColumn("own", F.lit(0)).withColumn("_row", F.monotonically_increasing_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    # Dealt by their content, so that a task that is run again deals them as before.
    return whole, numbered.mapInArrow(cut, kinds).repartition("_row", F.xxhash64("piece"))


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for piece, own in zip(b.column("piece").to_pylist(), b.column("own").to_pylist()):
                if piece:
                    total += np.bincount(buckets(piece, own)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    both = [x.select("piece", "own").mapInArrow(run, "bucket long, n long") for x in pieces(docs, ())]
    return both[0].union(both[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all buckets: thousandths of the log of how much likelier it is in ``target`` than in ``docs``, rounded down."""
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    s, t = bucket_counts(docs).withColumnRenamed("n", "s"), bucket_counts(target).withColumnRenamed("n", "t")
    both = every.join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left").na.fill(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    x = lambda c: F.col(c).cast("double")
    ratio = (x("t") + 1) * (x("all_s") + BUCKETS) / ((x("s") + 1) * (x("all_t") + BUCKETS))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_features and weight of every row."""
    worth = np.zeros(BUCKETS, np.int64)
    for r in gains(docs, target).collect():  # one row for each bucket
        worth[r.bucket] = r.gain
    worth = docs.sparkSession.sparkContext.broadcast(worth)

    def run(batches):
        for b in batches:
            out = [buckets(p, own) if p else (0, np.empty(0, np.int64)) for p, own in zip(b.column("piece").to_pylist(), b.column("own").to_pylist())]
            numbers = [[n for n, _ in out], [len(x) for _, x in out], [int(worth.value[x].sum()) for _, x in out]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], b.column("_row"), *(pa.array(x, pa.int64()) for x in numbers)], names)

    whole, cut = pieces(docs, keep)
    own = whole.columns[: len(keep)]
    names = [*own, "_row", "n_words", "n_features", "weight"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema if f.name in own) + ", _row long, n_words long, n_features long, weight long"
    kinds = kinds.removeprefix(", ")
    short, parts = whole.mapInArrow(run, kinds).drop("_row"), cut.mapInArrow(run, kinds)
    first = [F.first(c).alias(c) for c in own]
    sums = parts.groupBy("_row").agg(*first, *[F.sum(c).alias(c) for c in names[-3:]]).drop("_row")
    return short.unionByName(sums).select(*[F.col(c).alias(k) for c, k in zip(own, keep)], *names[-3:])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, drawn by a digest of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, score, ...) with rank 1, 2, ... of the rows drawn, null for all others."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    can = scored.filter(F.col("n_words") >= least)
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(can.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    upto = Window.orderBy("_range")
    before = sizes.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    placed = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(before), "_range")
    rank = (F.col("_before") + F.col("_k")).cast("long")
    drawn = placed.withColumn("rank", F.when(rank <= F.floor(F.lit(percent).cast("long") * F.col("_all") / 100), rank))
    rest = scored.filter(F.coalesce(F.col("n_words") < least, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    found = weights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), target.select("text"))
    scored = checkpointed(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return ranked(scored, percent, least)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and the draw of all documents towards the benchmark's texts."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
