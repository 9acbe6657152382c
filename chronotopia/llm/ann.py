"""Approximate nearest neighbours (largest inner product) by a permutation index.

Every vector is represented by its ``prefix`` nearest pivots in order of nearness, and posted, with the position, in the
inverted file of each of these pivots (at most 255). A query reads the files of its own nearest pivots and sums up the footrule
distance of the two orders (a pivot outside a prefix counts as next after it). The ``share`` of the rows of least
footrule, with all ties and all rows whose order agrees by half with the query's (so a crowd of near copies, however
large, is never cut off), is ranked again by the exact inner product in double precision. To make nearness of directions
agree with the inner product, vectors get one component more, which brings all to the largest length.

The pivots are 256 vectors of a bounded sample (the 2048 of the smallest hashes), each chosen farthest from those before
it, so near copies give one pivot; the index holds every row. Its files are cut by rows into blocks; the queries visit each
block, which answers with its best, and these are merged. Rows are sent once for each ``queries_block`` queries (so once,
up to 1.3 million rows), queries once for each block; a task holds one block of rows and one of queries. The same share
is ranked again at every size.

Edge cases: vectors that are null, zero or hold null or non-finite components, and those without vec_id, take no part;
vectors of each length have an index of their own (so lengths should be few) and are compared with that length only; rows
that share vec_id are rows of their own, each of them a query if the number says so, and each other's candidates; equal
scores rank by the smaller vec_id; with fewer candidates than ``k`` all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table
from .vectors import matrix, unit, usable

SAMPLE, PIVOTS, PREFIX, SHARE = 2048, 256, 64, 0.2
#: Most rows and most queries of a task; blocks of rows at least, so that small tables are shared by several tasks too.
ROWS_BLOCK, QUERIES_BLOCK, LEAST_BLOCKS = 65_536, 65_536, 8


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows divided by ``longest``, and one component more that makes their length 1."""
    x = x / longest
    return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    near = -(x @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix]


def apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the rows (of length 1), each the farthest from those before it."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


class Block:
    """The inverted files of some rows: a file has one byte for each row, the pivot's place in its order, or ``prefix``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows_of: np.ndarray, pivots: np.ndarray, longest: float, prefix: int) -> None:
        self.x, self.ids, self.rows_of, self.prefix = x, ids, rows_of, prefix
        self.files = np.full((len(pivots), len(x)), prefix, np.uint8)
        for at in range(0, len(x), 4096):
            own = orders(lifted(x[at : at + 4096], longest), pivots, prefix)
            self.files[own, at + np.arange(len(own))[:, None]] = np.arange(prefix, dtype=np.uint8)

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """For each row how far its footrule distance falls below that of orders without a common pivot, halved."""
        total = np.zeros(len(self.ids), np.uint16)
        far = np.empty(len(self.ids), np.uint8)
        for place, pivot in enumerate(order.tolist()):
            total += np.maximum(self.files[pivot], place, out=far, dtype=np.uint8)
        return self.prefix * self.prefix - total.astype(np.int64)

    def candidates(self, order: np.ndarray, k: int, share: float) -> np.ndarray:
        """Numbers of the rows to rank again; all rows where fewer than ``k`` have a pivot in common with the query."""
        close = self.closeness(order)
        want = min(len(close), max(k, int(np.ceil(share * len(close)))))
        edge = np.partition(close, len(close) - want)[len(close) - want]
        rows = np.flatnonzero(close >= max(1, min(edge, self.prefix * (self.prefix + 1) / 4)))
        return rows if len(rows) > k else np.arange(len(close))

    def search(self, q: np.ndarray, order: np.ndarray, own: int, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the best rows but the one numbered ``own``, best first."""
        rows = self.candidates(order, k, share)
        rows = rows[self.rows_of[rows] != own]
        rough = self.x[rows] @ q
        if len(rows) > k:
            edge = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= edge - 1e-9 * max(1.0, abs(edge))]
        score = (self.x[rows] * q).sum(axis=1)
        best = np.lexsort((self.rows_of[rows], self.ids[rows], -score))[:k]
        return rows[best], score[best]


def _search_length(
    src: DataFrame, dim: int, n: int, queries: int, longest: float, every: int, k: int, pivots: int, prefix: int, share: float, rows_block: int, queries_block: int
) -> DataFrame:
    """The search among the vectors of one length."""
    src = src.filter(F.col("dim") == dim).select("vec_id", "row", "x")
    sample = np.array([r["x"] for r in src.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id", "x").limit(SAMPLE).collect()], np.float64).reshape(-1, dim)
    chosen = apart(lifted(sample, longest), pivots)
    fitted = src.sparkSession.sparkContext.broadcast((chosen, longest))
    prefix = min(prefix, len(chosen), 255)
    nb, nq = min(n, max(LEAST_BLOCKS, -(-n // rows_block))), max(1, -(-queries // queries_block))
    spread = lambda seed, of: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    rows = src.select(F.lit(False).alias("is_query"), "vec_id", "row", "x", spread(1, nb).alias("b"), each(nq).alias("q"))
    asks = src.filter(F.col("vec_id") % every == 0).select(F.lit(True).alias("is_query"), "vec_id", "row", "x", spread(2, nq).alias("q"), each(nb).alias("b"))

    def answer(t: pa.Table) -> pa.Table:
        p, m = fitted.value
        x, ids, number, query = matrix(t.column("x"), dim), t.column("vec_id").to_numpy(), t.column("row").to_numpy(), t.column("is_query").to_numpy()
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if query.any() and not query.all():
            block = Block(x[~query], ids[~query], number[~query], p, m, prefix)
            own = orders(np.c_[unit(x[query]), np.zeros(query.sum())], p, prefix)
            for q, order, i, r in zip(x[query], own, ids[query].tolist(), number[query].tolist()):
                best, score = block.search(q, order, r, k, share)
                found.append((np.full(len(best), r), np.full(len(best), i), block.ids[best], block.rows_of[best], score))
        names = ("query", "query_id", "vec_id", "row", "score")
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in zip(names, zip(*found))})

    both = rows.unionByName(asks).groupBy("b", "q").applyInArrow(answer, "query long, query_id long, vec_id long, row long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE,
    rows_block: int = ROWS_BLOCK, queries_block: int = QUERIES_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id ``every`` divides the ``k`` nearest of all other rows."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("x"))
    src = src.filter(F.col("vec_id").isNotNull() & usable("x")).withColumn("dim", F.size("x"))
    src = checkpointed(src.withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    lengths = src.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(square).alias("m"))
    found = []
    for r in sorted(lengths.collect()):
        if r["n"] > 1 and r["q"]:
            found.append(_search_length(src, r["dim"], r["n"], r["q"], float(np.sqrt(r["m"])), every, k, pivots, prefix, share, rows_block, queries_block))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return search(table(spark, sf_dir, "embeddings"))
