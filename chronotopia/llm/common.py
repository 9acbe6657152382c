"""Helpers that the training-data operators share: tables, checkpoints, prefix sums, components."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce, wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField

from ..sources.session import checkpointed, remove_path, shared_folder  # noqa: F401

#: What Spark takes for the limit where none is set.
ARROW_DEFAULT = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session of which Arrow batches hold 8 MB of texts at most (unless a limit is set there).

    A worker then holds little at a time, however long the texts are.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == ARROW_DEFAULT:
        conf.set(name, "8m")
    return df


#: Names of a row's key, see row_key.
KEY = ("_row_a", "_row_b")


def own_names(*used: str) -> Callable:
    """Of an operator from rows to rows: all columns but ``used`` travel under plain names and get theirs back, so no name can clash with the operator's own."""

    def of(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            plain = [c if c in used else f"x{i}" for i, c in enumerate(docs.columns)]
            out, back = operator(docs.toDF(*plain), *args, **kwargs), dict(zip(plain, docs.columns))
            return out.toDF(*[back.get(c, c) for c in out.columns])

        return run

    return of


def _hashable(field: StructField) -> Column:
    """A column as it can be hashed; maps are by what they hold, in any order."""
    kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
    if isinstance(field.dataType, MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e.alias("e")))))
    return F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c


def row_key(docs: DataFrame) -> list[Column]:
    """128 bits of hash over all columns, nulls told apart: rows with one key are equal, so any of them will do."""
    cols = [x for f in docs.schema for x in (F.col(f"`{f.name}`").isNull(), _hashable(f))]
    return [F.xxhash64(F.lit(seed), *cols).alias(name) for seed, name in zip((17, 18), KEY)]


def _and(conds: Sequence[Column]) -> Column:
    return reduce(lambda p, q: p & q, conds)


def running_sum(df: DataFrame, keys: Sequence[str], bin_col: str, order: Sequence[Column], value: Column, out: str, coarse: int = 0) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same ``keys`` up to and including this row.

    ``bin_col`` is a coarse, order-preserving prefix of ``order``: rows are summed inside (keys, bin) only, and
    the bins' totals are summed over the small aggregate. So a key that holds most rows is still spread over all
    tasks, and no sum runs over more than one bin of rows. With many bins their totals are summed in groups of
    2^``coarse`` bins first, and then the groups' totals.
    """
    totals = df.groupBy(*keys, bin_col).agg(F.sum(value).alias("_total"))
    earlier = lambda *by: Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda rows, *by: rows.withColumn("_before", F.coalesce(F.sum("_total").over(earlier(*by)), F.lit(0)))
    if coarse:
        totals = totals.withColumn("_group", F.shiftright(bin_col, coarse)).withColumn("_at", F.col(bin_col))
        groups = sums(totals.groupBy(*keys, "_group").agg(F.sum("_total").alias("_total")).withColumn("_at", F.col("_group")), *keys)
        same = _and([F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*keys, "_group")])
        inner = sums(totals, *keys, "_group").alias("t").join(groups.alias("g"), same)
        offsets = inner.select(*[F.col(f"t.{c}") for c in (*keys, bin_col)], (F.col("t._before") + F.col("g._before")).alias("_before"))
    else:
        offsets = sums(totals.withColumn("_at", F.col(bin_col)), *keys).drop("_total", "_at")
    same = _and([F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, bin_col)])
    joined = df.alias("l").join(offsets.alias("r"), same, "left").select("l.*", "r._before")
    inside = Window.partitionBy(*keys, bin_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.sum(value).over(inside) + F.col("_before")).drop("_before")


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node reached) of the graph with edges a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


#: A key is hot if it holds more than this part of all rows; so there are at most so many hot keys.
HOT = 4096


def join_hot(rows: DataFrame, totals: DataFrame, key: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``totals``, which has one row for each ``key`` and in ``_n`` how many rows have it; ``_n`` is dropped.

    Rows of hot keys (over ``total`` / HOT of them; ``total`` is the number of rows) stay where they are and meet their
    key's one row by a broadcast of at most HOT rows; all others are dealt by key.
    """
    keys, hot = [key] if isinstance(key, str) else key, F.col("_n") > max(1, total // HOT)
    heavy, light = F.broadcast(totals.filter(hot).drop("_n")), totals.filter(~hot).drop("_n")
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node that it reaches.

    Alternates the large-star and small-star steps until the edges stay as they are; every round is cut off with
    a checkpoint. A node's neighbours are not gathered in one place: minima are aggregated, then joined back, and nodes
    with many neighbours by a broadcast.
    """
    e = checkpointed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    count, state = e.count(), None
    for _ in range(most_rounds):
        if not count:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("_n"))
        large = join_hot(both, low, "u", 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = join_hot(large, low2, "u", count).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        e = checkpointed(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        count, state = now[0], now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
