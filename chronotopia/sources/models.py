"""Language models and other remote services as injected callables over rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Answers worth another try, and the waits before them in seconds.
RETRY_STATUS = (429, 500, 529)
WAITS = (15, 60)


class ServiceError(Exception):
    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(f"{status} {message}".strip())
        self.status, self.message = status, message

    def __reduce__(self):
        return type(self), (self.status, self.message)


def with_retries(call: Callable[[dict], dict], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> Callable[[dict], dict]:
    """``call`` tried again after each wait when a service is busy."""

    def tried(row: dict) -> dict:
        for wait in waits:
            try:
                return call(row)
            except ServiceError as e:
                if e.status not in RETRY_STATUS:
                    raise
                sleep(wait)
        return call(row)

    return tried


class BudgetSpent(Exception):
    """No call is made any more: what the calls so far would have cost has reached the budget."""


def with_budget(call: Callable[[dict], dict], cost: Callable[[dict], float], budget: float | None) -> Callable[[dict], dict]:
    """``call`` until the answers' ``cost`` has reached ``budget`` (None: no bound), in one worker; ``lookups.looked_up`` counts for a run."""
    spent = 0.0

    def guarded(row: dict) -> dict:
        nonlocal spent
        if budget is not None and spent >= budget:
            raise BudgetSpent(f"{spent:.2f} of {budget:.2f} spent")
        answer = call(row)
        spent += cost(answer)
        return answer

    return guarded


def throttled(call: Callable[[dict], dict], gap: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[dict], dict]:
    """``call``, begun ``gap`` seconds after the one before it at the earliest, in one worker; ``lookups.looked_up`` keeps a run's pace."""
    last = None

    def waiting(row: dict) -> dict:
        nonlocal last
        if last is not None and (left := last + gap - clock()) > 0:
            sleep(left)
        last = clock()
        return call(row)

    return waiting


def answers(rows: DataFrame, call: Callable[[dict], dict], schema: str) -> DataFrame:
    """``call``'s answer to each row, in batches; the callable brings its own client and limits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [call(r) for r in pdf.to_dict("records")]
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def fold_chapters(chapters: DataFrame, call: Callable[[str, dict, int], dict], schema: str, text: str = "text") -> DataFrame:
    """Live extraction, which is sequential in a book: ``call(text, registry so far, chapter)`` for each chapter in order.

    ``call`` returns {"rows": [...], "registry": {...}}; rows have ``schema``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        registry, rows = {"characters": [], "locations": []}, []
        for r in pdf.sort_values("chapter").to_dict("records"):
            got = call(r[text], registry, r["chapter"])
            registry = got["registry"]
            rows += got["rows"]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return chapters.groupBy("book_id").applyInPandas(run, schema)
