"""Selections under quotas and coverage rules. Loops run over rules or kinds, of which there are few; rows stay distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize


def by_rules(pool: DataFrame, rules: Sequence[tuple[str, Column, int]], order: Sequence[Column | str], key: str, template: str) -> tuple[DataFrame, list[dict]]:
    """(chosen rows with ``rule``, shortfalls): each rule (name, test, quota) in turn takes the first rows by ``order`` that meet it until as many chosen
    rows meet it as its quota; a row or a template is chosen once. Rules that fall short are reported. The order must be total.

    Chosen rows are bounded by the quotas. A rule's candidates lose those that repeat a template by a partial aggregate before they are ordered.
    """
    rank = F.struct(*order)
    chosen = None
    short = []
    for name, test, quota in rules:
        have = chosen.where(test).count() if chosen is not None else 0
        if have < quota:
            left = pool.where(test)
            if chosen is not None:
                left = left.join(F.broadcast(chosen.select(key)), key, "left_anti").join(F.broadcast(chosen.select(template)), template, "left_anti")
            first = left.groupBy(template).agg(F.min(F.struct(rank.alias("r"), F.struct(*[F.col(c) for c in pool.columns]).alias("row"))).alias("m"))
            taken = materialize(first.orderBy("m.r").limit(quota - have).select("m.row.*").withColumn("rule", F.lit(name)), "taken")
            chosen = taken if chosen is None else materialize(chosen.unionByName(taken), "chosen")
            have = chosen.where(test).count()
        if have < quota:
            short.append({"rule": name, "quota": quota, "have": have})
    return (chosen if chosen is not None else pool.limit(0).withColumn("rule", F.lit(""))), short


def by_strata(pool: DataFrame, strata: str, targets: dict[str, int], total: int, order: Sequence[Column | str], key: str) -> DataFrame:
    """The strata of an array column in order of their size (then name) take the first rows by ``order`` until as many chosen rows belong to them as
    their target, rows of several strata counting in each; then the first rows overall fill up to ``total``."""
    sizes = {r[0]: r[1] for r in pool.select(F.explode(F.array_distinct(strata)).alias("s")).where(F.col("s").isin(*targets)).groupBy("s").count().collect()}
    chosen = pool.limit(0)
    for name in sorted(targets, key=lambda s: (sizes.get(s, 0), s)):
        need = targets[name] - chosen.where(F.array_contains(strata, name)).count()
        if need > 0:
            left = pool.where(F.array_contains(strata, name)).join(F.broadcast(chosen.select(key)), key, "left_anti")
            chosen = materialize(chosen.unionByName(left.orderBy(*order).limit(need)), "chosen")
    need = total - chosen.count()
    if need > 0:
        chosen = materialize(chosen.unionByName(pool.join(F.broadcast(chosen.select(key)), key, "left_anti").orderBy(*order).limit(need)), "chosen")
    return chosen


def ensure_coverage(splits: DataFrame, kinds: DataFrame, group: str = "group", kind: str = "kind", least: int = 3) -> DataFrame:
    """``splits`` (group, n, split) with whole groups moved so that validation and test each hold every kind that at least ``least`` groups have.

    For each kind by name and each held-out split that lacks it, the smallest group that holds it (then the least id) moves there: from train, or, if train has
    no two, from the other held-out split if that has two. One aggregate for each kind; the moves are few and travel as literals.
    """
    held = materialize(kinds.select(group, kind).distinct().join(splits.select(group, "n", "split"), group), "held")
    names = [r[0] for r in held.groupBy(kind).count().where(F.col("count") >= least).orderBy(kind).collect()]
    moved: dict = {}

    def now() -> Column:
        value = F.col("split")
        for g, s in moved.items():
            value = F.when(F.col(group) == g, s).otherwise(value)
        return value

    for name in names:
        told = held.where(F.col(kind) == name).withColumn("split", now()).groupBy("split").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n", group)).alias("m")).collect()
        have = {r["split"]: (r["c"], r["m"][group]) for r in told}
        for target, other in (("validation", "test"), ("test", "validation")):
            if target in have:
                continue
            donor = next((s for s in ("train", other) if have.get(s, (0,))[0] >= 2), None)
            if donor:
                moved[have[donor][1]] = target
                told = held.where(F.col(kind) == name).withColumn("split", now()).groupBy("split").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n", group)).alias("m")).collect()
                have = {r["split"]: (r["c"], r["m"][group]) for r in told}
    return splits.withColumn("split", now())


def micro_batches(rows: DataFrame, order: Column | str, size: int) -> DataFrame:
    """``rows`` with ``chunk``: batches of ``size`` in the given order, numbered from 0 without a sort in one task."""
    from inkwell.operators.ranks import number_rows

    return number_rows(rows, order, name="chunk").withColumn("chunk", F.floor(F.col("chunk") / size))


def first_by_priority(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of ``sources`` with each key from the first source that has it, as ``priority``, and whether later ones differ."""
    whole = None
    for k, df in enumerate(sources):
        told = df.withColumn("priority", F.lit(k))
        whole = told if whole is None else whole.unionByName(told)
    w = Window.partitionBy(key)
    rest = [c for c in sources[0].columns if c != key]
    told = whole.withColumn("differs", F.size(F.collect_set(F.struct(*rest)).over(w)) > 1).withColumn("at", F.row_number().over(w.orderBy("priority")))
    return told.where("at = 1").drop("at")
