"""Hash-ordered sampling, quotas, splits and diverse choice."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import seeded_hash


def queue(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first n rows in seeded hash order with their position from 1. A top-n: tasks bring n rows each."""
    first = rows.withColumn("__h", seeded_hash(seed, F.col(key))).orderBy("__h", key).limit(n)
    return first.withColumn("position", F.row_number().over(Window.orderBy("__h", key))).drop("__h")


def quota(rows: DataFrame, by: str, key: str, seed: str, n: Column) -> DataFrame:
    """The first n rows of each stratum in seeded hash order, where n may depend on the stratum's size ``population``. A
    threshold on the hash's leading digits first cuts each stratum down to about twice its quota, so a stratum with a third of all rows is
    not sorted whole; strata that come out short fall back to all their rows."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("population")).withColumn("__n", n)
    told = rows.join(sizes, by).withColumn("__h", seeded_hash(seed, F.col(key)))
    unit = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = unit <= (F.col("__n") * 2 + 20) / F.col("population")
    enough = told.groupBy(by).agg((F.count_if(near) >= F.first("__n")).alias("__enough"))
    thin = told.join(enough, by).where(near | ~F.col("__enough"))
    ranked = thin.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("__h", key)))
    return ranked.where(F.col("position") <= F.col("__n")).drop("__n", "__h", "__enough")


def round_robin(rows: DataFrame, family: str, cue: str, order: str, n: int) -> DataFrame:
    """n rows of each family, taken from its cues in turn; cues in the order of their first rows."""
    by_cue = Window.partitionBy(family, cue)
    told = rows.withColumn("__round", F.row_number().over(by_cue.orderBy(order))).withColumn("__first", F.min(order).over(by_cue))
    told = told.where(F.col("__round") <= n).withColumn("position", F.row_number().over(Window.partitionBy(family).orderBy("__round", "__first")))
    return told.where(F.col("position") <= n).drop("__round", "__first")


def split_groups(groups: DataFrame, key: str, seed: str, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """Whole groups to test, validation and train by rank in seeded hash order. Ranks come from counts of hash prefixes, so
    no task sorts all groups."""
    told = groups.select(key).distinct().withColumn("__h", seeded_hash(seed, F.col(key))).withColumn("__b", F.substring("__h", 1, 3))
    bins = told.groupBy("__b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("__b")  # 4,096 rows at most
    bins = bins.select("__b", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("n"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    told = told.join(F.broadcast(bins), "__b").withColumn("place", place)
    a = F.round(F.col("n") * test)
    b = a + F.round(F.col("n") * validation)
    return told.select(key, F.when(F.col("place") <= a, "test").when(F.col("place") <= b, "validation").otherwise("train").alias("split"))


def pick_diverse(items: Sequence[tuple[str, Sequence[str]]], n: int, seed: str) -> list[str]:
    """n ids of (id, features), each the one that adds most: an item is worth the sum over its features of the harmonic share 1 / (1 + k), where
    k items with that feature are chosen already; among equals the first in seeded hash order. The order of ``items`` has no effect."""
    if not items:
        return []
    keys = np.array([hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i, _ in items])
    ranked = np.argsort(keys, kind="stable")
    names = {f: c for c, f in enumerate(sorted({f for _, fs in items for f in fs}, key=str))}
    holds = np.zeros((len(items), len(names)))
    for row, at in enumerate(ranked):
        for f in items[at][1]:
            holds[row, names[f]] += 1
    chosen, used = [], np.zeros(len(names))
    worth = np.zeros(len(items))
    for _ in range(min(n, len(items))):
        worth = np.where(worth == -np.inf, -np.inf, np.round(holds @ (1 / (1 + used)), 12))
        row = int(worth.argmax())  # the first of equals
        chosen.append(items[ranked[row]][0])
        used += holds[row]
        worth[row] = -np.inf
    return chosen


def diverse_sample(rows: DataFrame, by: str, key: str, features: str, n: int, seed: str) -> DataFrame:
    """(by, key, position): a greedy diverse choice of n in each stratum, among all its rows. Rows of equal features differ in their hash
    alone, so no more than the first n in hash order of each set of features can be taken; a partial top-n finds those, and a
    stratum's task holds n rows for each different set of features."""
    told = rows.select(by, F.col(key).cast("string").alias("__key"), features)
    order = Window.partitionBy(by, features).orderBy(seeded_hash(seed, F.coalesce("__key", F.lit("None"))), "__key")
    first = told.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")

    def choose(frame):
        import pandas as pd

        got = pick_diverse(list(zip(frame["__key"], frame[features], strict=True)), n, seed)
        taken = pd.array([None if x is None else int(x) for x in got], "Int64")
        return pd.DataFrame({by: [frame[by].iloc[0]] * len(got), key: taken, "position": pd.Series(range(1, len(got) + 1), dtype="int64")})

    return first.groupBy(by).applyInPandas(choose, f"{by} string, {key} long, position long")
