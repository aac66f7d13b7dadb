"""Classification, span and agreement metrics as aggregates. 0/0 counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, predicted: Column, gold: Column) -> Column:
    """2 tp / (predicted + gold), which is the harmonic mean of precision and recall."""
    return ratio(2 * tp, predicted + gold)


def confusion(rows: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Non-zero cells: by, gold, pred, n."""
    return rows.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support of every label that is gold or predicted, from confusion cells: each cell
    counts once as gold and once as prediction, so one aggregate over twice the cells is enough."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sides = cells.select(*by, "gold", "pred", "n", F.explode(F.array(
        F.struct(F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("s"))
    told = sides.groupBy(*by, F.col("s.label").alias("label")).agg(F.sum("s.tp").alias("tp"), F.sum("s.g").alias("support"), F.sum("s.p").alias("predicted"))
    return told.select(
        *by, "label", "support", "predicted", "tp", ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"), f1(F.col("tp"), F.col("predicted"), F.col("support")).alias("f1"))


def kappa(cells: DataFrame) -> DataFrame:
    """n, agreement and Cohen's kappa of two labellers from confusion cells; kappa is null where chance agreement is 1."""
    one = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("same"))
    a = cells.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("a"))
    b = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("b"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n").cast("double") * F.col("n"))
    return one.crossJoin(chance).select("n", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))  # one row each
