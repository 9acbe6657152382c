"""Presence events as they arrive: the point view is stateless, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.points import event_match_points


def append_points(events: DataFrame, locations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Match points of all events that are there and not yet taken, appended to ``path`` (exactly once)."""
    rows = event_match_points(events, locations)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
