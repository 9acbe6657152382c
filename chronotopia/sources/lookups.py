"""Look-ups at a service for a whole run: one pace, one budget and one stored cache for all workers.

Distinct keys are asked once. Answers are appended to a stored table, so a later run, or one that was broken off, asks only
for what is missing; failures are kept for the run's own use and asked again by the next one. All workers share one pace
without talking to each other: the driver sets a start time, and worker i of n may begin a call only in the slots start +
(m * n + i) * gap, so that no two slots lie closer than the gap, also when a task is run again. (Clocks are taken to agree,
as those of a cluster do; speculative copies of tasks should be off.) The budget is kept in waves: a wave has as many calls as the
rest of the budget pays for at the highest price seen, and its sum is read from the stored table before the next one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import BudgetSpent, ServiceError
from .session import checkpointed
from .store import _exists

Call = Callable[[dict], list[dict]]


class Slots:
    """When worker ``i`` of ``n`` may begin its next call."""

    def __init__(self, start: float, gap: float, i: int, n: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.start, self.gap, self.i, self.n, self.clock, self.sleep, self.last = start, gap, i, n, clock, sleep, -1

    def wait(self) -> float:
        """Wait for the next own slot; its time."""
        if not self.gap:
            return self.clock()
        step = self.gap * self.n
        first = self.start + self.i * self.gap
        self.last = max(self.last + 1, -int((first - self.clock()) // step))
        at = first + self.last * step
        while (left := at - self.clock()) > 0:
            self.sleep(left)
        return at


def looked_up(
    keys: DataFrame, call: Call, answer: str, path: str, gap: float = 1.0, budget: float | None = None, cost: Callable[[list[dict]], float] | None = None, workers: int = 2, wave: int = 1000
) -> DataFrame:
    """``keys``' columns and the columns of ``answer`` (DDL), a row for each answer, of all distinct keys that the service has answered.

    ``call(key)`` gives a list of answers, which may be empty, or raises ServiceError. ``path``: the stored table, of a
    shared store. ``gap``: seconds between calls, of all workers together. ``budget``: BudgetSpent is raised when what the calls
    of this run ``cost`` has reached it and keys are left; what was answered stays. At most ``workers`` ask at a time, in
    waves of at most ``wave`` calls.
    """
    spark, names, run = keys.sparkSession, keys.columns, uuid.uuid4().hex
    fields = [f.name for f in spark.createDataFrame([], answer).schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    stored = f"{kinds}, answers string, cost double, ok boolean, run string"
    wanted, start = checkpointed(keys.distinct()), time.time()

    def table() -> DataFrame:
        return spark.read.schema(stored).parquet(path) if _exists(spark, path) else spark.createDataFrame([], stored)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slots = Slots(start, gap, TaskContext.get().partitionId(), workers)
        for pdf in batches:
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                slots.wait()
                try:
                    found, ok = call(dict(row)), True
                except ServiceError:
                    found, ok = [], False
                yield pd.DataFrame([[*(row[c] for c in names), json.dumps([{f: a.get(f) for f in fields} for a in found]), float(cost(found)) if cost and ok else 0.0, ok, run]], columns=[*names, "answers", "cost", "ok", "run"])

    dearest = spent = 0.0
    while True:
        done = table().filter((F.col("ok")) | (F.col("run") == run)).select(*names).distinct()
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in names]
        left = wanted.alias("k").join(done.alias("d"), same, "left_anti")
        # The first call tells a price.
        most = wave if budget is None else min(wave, max(1, int((budget - spent) // dearest) if dearest else 1))
        some = checkpointed(left.orderBy(*names).limit(most))
        if some.isEmpty():
            break
        if budget is not None and spent >= budget:
            raise BudgetSpent(f"{spent:.2f} of {budget:.2f} spent")
        # Dealt evenly, and asked by so many tasks as share the slots.
        dealt = some.repartition(workers)
        dealt.mapInPandas(ask, stored).write.mode("append").parquet(path)
        if budget is not None:
            own = table().filter(F.col("run") == run).agg(F.sum("cost").alias("s"), F.max("cost").alias("m")).first()
            spent, dearest = own["s"] or 0.0, max(own["m"] or 0.0, dearest)
    one = table().filter("ok").dropDuplicates(names)  # two runs at a time may both have asked
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in names]
    found = wanted.alias("k").join(one.alias("t"), same).select(*[F.col(f"k.{c}").alias(c) for c in names], F.explode(F.from_json("t.answers", f"array<struct<{_struct(spark, answer)}>>")).alias("_a"))
    return found.select(*names, *[F.col(f"_a.{f}").alias(f) for f in fields])


def _struct(spark: SparkSession, ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in spark.createDataFrame([], ddl).schema)


GAZETTEER = "rank int, display_name string, importance double, addresstype string, place_city string, place_country string, place_region string"


def gazetteer(locations: DataFrame, call: Call, path: str, gap: float = 1.0, workers: int = 2) -> DataFrame:
    """Rows for ``places.geo_backfill``: the answers for the most specific known level of every real place, each level and name asked once."""
    from ..operators.places import deepest_level

    level, value = deepest_level()
    asked = locations.filter("location_type = 'real'").select(level.alias("level"), value.alias("value")).filter("level IN ('country', 'region', 'city')")
    return looked_up(asked, call, GAZETTEER, path, gap, workers=workers)
