"""Labelling by a function that may fail, in bounded batches, with failures as rows; resuming from what is done."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_rows(rows: DataFrame, labeller: Callable[[str], str], key: str = "id", text: str = "text", workers: int = 4, tries: int = 2, pause: float = 0.1) -> DataFrame:
    """(key, label, error, attempts): ``labeller`` of each text, at most ``workers`` at a time in a task; a text that fails ``tries`` times has its error in
    place of a label, so no row is lost and no job fails for it. For labellers that wait for something; the order of rows is kept in a batch."""

    def one(t: str | None) -> tuple[str | None, str | None, int]:
        error = None
        for attempt in range(1, tries + 1):
            try:
                return labeller(t), None, attempt
            except Exception as e:  # becomes the row's error
                error = f"{type(e).__name__}: {e}"
                if attempt < tries:
                    time.sleep(pause)
        return None, error, tries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                told = list(pool.map(one, frame["__text"]))
                yield pd.DataFrame({"k": frame["k"], "label": [x for x, _, _ in told], "error": [e for _, e, _ in told], "attempts": pd.array([n for *_, n in told], "Int32")})

    kind = rows.schema[key].dataType.simpleString()
    told = rows.select(F.col(key).alias("k"), F.col(text).alias("__text")).mapInPandas(run, f"k {kind}, label string, error string, attempts int")
    return told.withColumnRenamed("k", key)


def unfinished(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows that no successful result has yet."""
    good = done.where("error is null").select(F.col(key).alias("__done")).distinct()
    return rows.join(good, rows[key].eqNullSafe(F.col("__done")), "left_anti")
