"""A bounded registry of values by key, and a snapshot that is kept up after each change, over tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST = 200


def register(held: list[str], values: list[str], most: int = MOST) -> tuple[list[str], list[tuple[str, str]]]:
    """The values held after more arrive, oldest first, and what happened: (value, added) and (value, evicted) in order. A value that is held
    keeps its place; where the registry is full the oldest makes room."""
    now, events = dict.fromkeys(held), []
    for v in values:
        if v in now:
            continue
        if len(now) >= most:
            oldest = next(iter(now))
            del now[oldest]
            events.append((oldest, "evicted"))
        now[v] = None
        events.append((v, "added"))
    return list(now), events


def registry(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(key, value, event) of a stream (key, value, ts): what enters and leaves each key's registry, in order of arrival within a micro-batch. A key's state
    is ``most`` values at most."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["ts", "value"])
        held, events = register(held, frame["value"].tolist(), most)
        state.update((held,))
        yield pd.DataFrame({"key": [key[0]] * len(events), "value": [v for v, _ in events], "event": [e for _, e in events]})

    return rows.select("key", "value", "ts").groupBy("key").applyInPandasWithState(
        update, "key string, value string, event string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def snapshot(events: DataFrame) -> DataFrame:
    """Count, total and last time by type: over a table the final snapshot, over a stream (output mode complete or update) that after each change."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.max("ts").alias("last"))


def newest_first(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` values of each key that arrived last by first arrival: what the registry of a table's rows holds where each value comes once."""
    first = rows.groupBy(key, "value").agg(F.min("ts").alias("first"))
    return first.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(F.col("first").desc(), F.col("value").desc()))).where(F.col("age") <= most)
