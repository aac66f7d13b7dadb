"""Numbering rows of a whole table in an order without sorting it in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import fresh, materialize


def number_rows(df: DataFrame, *order: Column | str, name: str) -> DataFrame:
    """``df`` with ``name``: each row's number from 0 in the given order; rows that tie are numbered in any order.

    A range-partitioned sort is stored with each row's place in its partition; the rows of the partitions before are added
    to it. Only one count for each partition reaches the driver.
    """
    at, part = fresh(df, "at"), fresh(df, "part")
    placed = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn(part, F.shiftright(at, 33).cast("int"))
    sizes = sorted(placed.groupBy(part).count().collect())
    firsts = [0, *accumulate(n for _, n in sizes)]
    bases = df.sparkSession.createDataFrame(
        [(p, first) for (p, _), first in zip(sizes, firsts, strict=False)], f"{part} int, base long")
    bases = bases.withColumnRenamed("base", base := fresh(df, "base"))
    return placed.join(F.broadcast(bases), part).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col(base) + F.col(at).bitwiseAND((1 << 33) - 1)).alias(name))
