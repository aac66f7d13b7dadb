"""Leakage-safe splits: whole groups dealt to train, validation and test, stratum by stratum."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import seeded_hash
from inkwell.operators.ranks import number_rows
from inkwell.session import materialize

NAMES = ("train", "validation", "test")
PERCENT = (70, 15, 15)
BLOCK = 100_000


def deal(sizes: list[tuple[int, int]], seed: str, percent: tuple[int, ...] = PERCENT) -> dict[int, str]:
    """Splits of (group, size): largest groups first, equal sizes in seeded hash order, each to the split that lacks most rows, the
    earlier split among equals. The definition; ``leakage_safe_split`` gives the same for any number of groups."""
    wanted = [p * sum(n for _, n in sizes) for p in percent]
    out = {}
    for group, n in sorted(sizes, key=lambda g: (-g[1], hashlib.sha256(f"{seed}:{g[0]}".encode()).hexdigest())):
        at = wanted.index(max(wanted))
        wanted[at] -= 100 * n
        out[group] = NAMES[at]
    return out


def shares(wanted: list[int], n: int, c: int) -> list[int]:
    """How many of c groups of n rows each split gets: the c largest of the values wanted[s] - 100 * n * j for j = 0, 1, ... by split s."""
    count = lambda x: sum(max(0, (w - x) // (100 * n) + 1) for w in wanted)
    low, high = min(wanted) - 100 * n * (c + 1), max(wanted) + 1
    while high - low > 1:  # the largest value that c groups reach
        middle = (low + high) // 2
        low, high = (middle, high) if count(middle) >= c else (low, middle)
    got = [max(0, (w - low - 1) // (100 * n) + 1) for w in wanted]
    for s, w in enumerate(wanted):
        if sum(got) < c and w >= low and (w - low) % (100 * n) == 0:
            got[s] += 1
    return got


def leakage_safe_split(rows: DataFrame, group: str, stratum: str, seed: str) -> DataFrame:
    """(group, n, stratum, split). A group's stratum is its most frequent one, the first by name among equals.

    Groups of one size in a stratum are dealt together: what each split lacks when its turn comes tells how many it gets and in which
    order, so only counts by stratum and size reach the driver. Groups are ranked by a range-partitioned sort and meet their places in a join.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("c"))
    main = F.min(F.struct((-F.col("c")).alias("m"), F.col(stratum).alias("s")))
    sizes = materialize(counts.groupBy(group).agg(F.sum("c").alias("n"), main.alias("main")).select(group, "n", F.coalesce("main.s", F.lit("")).alias("stratum")), "sizes")
    classes: dict[str, list[tuple[int, int]]] = {}
    for name, n, c in sizes.groupBy("stratum", "n").count().collect():
        classes.setdefault(name, []).append((n, c))
    plan = []
    for name, found in classes.items():
        wanted = [p * sum(n * c for n, c in found) for p in PERCENT]
        for n, c in sorted(found, reverse=True):
            got = shares(wanted, n, c)
            plan += [(name, n, s, list(wanted), got) for s in range(len(got)) if got[s]]
            wanted = [w - 100 * n * k for w, k in zip(wanted, got, strict=True)]
    told = spark.createDataFrame(plan, "stratum string, n long, s int, wanted array<long>, got array<long>")
    k = F.get("got", F.col("s"))
    blocks = told.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), k - 1, F.lit(BLOCK).cast("long")))).repartition("stratum", "n", "s", "first")
    places = blocks.withColumn("j", F.explode(F.sequence("first", F.least(F.col("first") + BLOCK, k) - 1)))
    step = F.col("n") * 100
    value = F.get("wanted", F.col("s")) - step * F.col("j")
    rank = F.lit(0).cast("long")
    for s in range(len(PERCENT)):  # of other splits those come before that lack more, or as much and stand earlier
        least = value + F.when(F.col("s") > s, 0).otherwise(1)
        before = F.greatest(F.floor((F.get("wanted", F.lit(s)) - least) / step) + 1, F.lit(0))
        rank = rank + F.when(F.col("s") == s, F.col("j")).otherwise(F.least(before, F.get("got", F.lit(s))))
    places = places.select("stratum", "n", rank.alias("rank"), F.get(F.array(*map(F.lit, NAMES)), F.col("s")).alias("split"))
    placed = number_rows(sizes, "stratum", "n", seeded_hash(seed, F.col(group)), name="place")
    firsts = placed.groupBy("stratum", "n").agg(F.min("place").alias("first"))
    ranked = placed.join(firsts, ["stratum", "n"]).withColumn("rank", F.col("place") - F.col("first"))
    return ranked.join(places, ["stratum", "n", "rank"]).select(group, "n", "stratum", "split")


def review_plan(rows: DataFrame, key: str, must: str, hard: str, seed: str, audit_rate: float = 0.1) -> DataFrame:
    """(key, action): must rows are all reviewed, hard ones too if longer than the median, of the rest a seeded share is audited, others are accepted."""
    told = rows.crossJoin(F.broadcast(rows.agg(F.percentile("n", 0.5).alias("median"))))  # one row
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    action = F.when(F.col(must), "must").when(F.col(hard) & (F.col("n") > F.col("median")), "hard").when(unit < audit_rate, "audit").otherwise("auto")
    return told.select(key, action.alias("action"))
