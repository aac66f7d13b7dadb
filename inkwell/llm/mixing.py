"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source has a target number of words. Within a source a document is expected to appear e times:
``e = min(CAP, c * preference)``, with c such that expected words meet the target; the preference
grows slowly with the length class of the document. floor(e) copies are certain. The rest is a
Pareto order sample: with inclusion probability p = e - floor(e) and a uniform u from the document, documents
are ranked by odds(u) / odds(p), and are taken in that order while their words fit what the source still
lacks. Documents that fit the gap that the first one too long leaves are then taken in the same order; where a small source
has no more of them, documents get further copies up to CAP, again in an order drawn at random.

No source is gathered in one task. The rank is a number v in [0, 1): words are summed by 1,024ths of its range
first, then by 1,024ths of the one range in which the target falls, and only the rows of that last range,
about a millionth of the source, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.native_text import broadcast_if_small, word_count
from inkwell.operators.ranks import number_rows
from inkwell.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
ZONES = 1 + int(CAP)  # of ranks: Pareto draws, then further copies
PASSES = 3
BINS = 1024
SMALL_ROWS = 200_000


def _stored(docs: DataFrame, seed: str, whole: bool) -> DataFrame:
    """What the plan reads of each row, stored once: __s, __size, __key (a digest of all that its draw depends on), __row, and the row
    itself (``whole``) or its doc_id as the struct ``doc``."""
    told = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if whole else ["doc_id"])]).alias("doc"), F.col("doc_id").cast("string").alias("i"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")).alias("__s"), F.col("text").alias("t"))
    return materialize(told.select(
        "doc", "__s", word_count(F.col("t")).alias("__size"),
        F.md5(F.concat_ws("/", F.lit(seed), F.coalesce("i", F.lit("")), "__s", F.coalesce("t", F.lit("")))).alias("__key"),
        F.monotonically_increasing_id().alias("__row")), "sizes")


def _drawn(stored: DataFrame) -> DataFrame:
    """``stored`` with __u in (0, 1). Rows that repeat each other wholly are numbered, so that each has a draw of its own: the rows of the
    partitions before, by counts, then those before it in its own partition."""
    h = F.xxhash64("__key")
    again = materialize(stored.groupBy(h.alias("h")).count().where("count > 1").select("h"), "repeats")
    number = F.lit(0)
    if not again.isEmpty():
        part = F.shiftright("__row", 33).alias("part")
        rows = stored.select(h.alias("h"), "__row", part).join(broadcast_if_small(again, SMALL_ROWS), "h")
        rows = materialize(rows.withColumn("at", F.row_number().over(Window.partitionBy("h", "part").orderBy("__row")) - 1), "repeats")
        before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = rows.groupBy("h", "part").count().select("h", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
        numbers = materialize(rows.join(bases, ["h", "part"]).select("__row", (F.col("base") + F.col("at")).alias("number")), "repeats")
        stored = stored.join(broadcast_if_small(numbers, SMALL_ROWS), "__row", "left")
        number = F.coalesce("number", F.lit(0))
    digest = F.md5(F.concat_ws("/", "__key", number.cast("string")))
    return stored.withColumn("__u", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48))


def _level(size: Column) -> Column:
    return F.length(F.bin(size)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(__s, source_size, target) from (__s, source_size): the sources by code point, null last, weigh
    ``weights`` in turn and share the sum of all sizes; no target is above ``cap`` times its source's size and the excess
    goes to the others by weight. The share is raised until no further source reaches its cap; each step is one aggregate."""
    turn = F.col("place") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    told = number_rows(sizes, F.substring("__s", 1, 1).desc(), "__s", name="place")
    told = materialize(told.select("__s", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("top")), "weights")
    share = -1.0
    while True:
        full = F.col("top") / F.col("w") < share
        rest, spare = told.agg(
            F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("top"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        if not spare or rest / spare <= share:
            break
        share = rest / spare
    return told.select("__s", "source_size", F.least("top", F.col("w") * share if share >= 0 else F.col("top")).alias("target"))


def _rates(classes: DataFrame, cap: float = CAP) -> DataFrame:
    """(__s, __l, source_size, target, e): expected copies by source and length class."""
    down = Window.partitionBy("__s").orderBy(F.col("__l").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    after = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    told = classes.withColumn("p", F.lit(1.0) + F.col("__l") / 16)
    told = told.withColumn(
        "c", (F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0)))
        / F.nullif(F.sum(F.col("p") * F.col("words")).over(after), F.lit(0)),
    )
    free = F.min(F.when(F.col("c") * F.col("p") < cap, F.struct((-F.col("__l")).alias("l"), "c")))
    told = told.withColumn("c", free.over(Window.partitionBy("__s"))["c"])
    return told.select(
        "__s", "__l", "source_size", "target",
        F.greatest(F.lit(0.0), F.least(F.lit(cap), F.coalesce(F.col("c") * F.col("p"), F.lit(cap)))).alias("e"),
    )


def _units(drawn: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds __whole, each row's certain copies, and __units, the ranks in [0, 1) of the further ones that it may have: first the
    Pareto draw, then, one more each, those up to CAP, whose ranks come after all draws of that kind."""
    joined = drawn.withColumn("__l", _level(F.col("__size"))).join(rates, ["__s", "__l"])
    whole = F.floor("e")
    p = F.col("e") - whole
    odds = F.col("__u") / (1 - F.col("__u")) * ((1 - p) / p)
    first = F.when(p > 0, odds / (1 + odds) / ZONES)
    more = [F.when(whole + (p > 0).cast("int") + z <= CAP, (z + F.col("__u")) / ZONES) for z in range(1, ZONES)]
    units = F.when(F.col("__size") > 0, F.array_compact(F.array(first, *more))).otherwise(F.array().cast("array<double>"))
    return joined.withColumn("__whole", whole).withColumn("__units", units)


def _cut(ranked: DataFrame, budget: DataFrame) -> DataFrame:
    """(__s, edge, cut, got): the longest run of rows in rank order whose words fit the source's budget is those with
    v < edge or v <= cut; got is their words. ranked: (__s, v, words)."""
    run = Window.partitionBy("__s").orderBy("b")

    def boundary(binned: DataFrame) -> DataFrame:
        told = binned.withColumn("upto", F.col("base") + F.sum("words").over(run))
        over = F.col("upto") > F.col("budget")
        return told.groupBy("__s").agg(
            F.max("budget").alias("budget"), F.min(F.when(over, F.col("b"))).alias("b"),
            F.coalesce(F.max(F.when(~over, F.col("upto"))), F.max("base")).alias("base"),
        )

    budget = broadcast_if_small(budget, SMALL_ROWS)
    one = ranked.groupBy("__s", F.floor(F.col("v") * BINS).alias("b")).agg(F.sum("words").alias("words"))
    first = materialize(boundary(one.join(budget, "__s").withColumn("base", F.lit(0))), "cut")
    at = broadcast_if_small(first.select("__s", "budget", "base", F.col("b").alias("b1")), SMALL_ROWS)
    inside = ranked.join(at, "__s").where(F.floor(F.col("v") * BINS) == F.col("b1"))
    second_bin = F.floor((F.col("v") * BINS - F.col("b1")) * BINS).alias("b")
    two = inside.groupBy("__s", second_bin).agg(
        F.sum("words").alias("words"), F.max("budget").alias("budget"), F.max("base").alias("base"))
    second = materialize(
        boundary(two).join(first.select("__s", F.col("b").alias("b1")), "__s"), "cut")
    at = broadcast_if_small(second.select("__s", "budget", "base", "b1", F.col("b").alias("b2")), SMALL_ROWS)
    rows = ranked.join(at, "__s").where(
        (F.floor(F.col("v") * BINS) == F.col("b1"))
        & (F.floor((F.col("v") * BINS - F.col("b1")) * BINS) == F.col("b2"))
    ).groupBy("__s", "v").agg(F.sum("words").alias("words"), F.max("budget").alias("budget"), F.max("base").alias("base"))
    told = rows.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("__s").orderBy("v")))
    fits = F.col("upto") <= F.col("budget")
    third = told.groupBy("__s").agg(
        F.max(F.when(fits, F.col("v"))).alias("cut"), F.max(F.when(fits, F.col("upto"))).alias("got"))
    return materialize(
        first.select("__s", F.col("b").alias("b1"), F.col("base").alias("base1"))
        .join(second.select("__s", F.col("b").alias("b2"), F.col("base").alias("base2")), "__s", "left")
        .join(third, "__s", "left")
        .select(
            "__s",
            F.when(F.col("b1").isNull(), F.lit(2.0))
            .otherwise((F.col("b1") + F.coalesce(F.col("b2") / BINS, F.lit(0.0))) / BINS).alias("edge"),
            F.coalesce("cut", F.lit(-1.0)).alias("cut"),
            F.coalesce("got", "base2", "base1").alias("got"),
        ), "cut")


def plan(docs: DataFrame, seed: str = "mix", whole: bool = True) -> DataFrame:
    """(doc, __size, source_size, target, __copies): every row of ``docs`` as a struct (only its doc_id unless ``whole``), its words, and how
    often the mix takes it, 0 to 3.

    A null or empty text has size 0 and no effect; a source of such texts alone has target 0. A null source is a source of its own, the
    last. The draw depends on doc_id (null counts as empty), source, text and the seed, so reruns agree; rows that repeat each other
    in all of them are numbered and have a draw each. An empty table gives no rows. Other columns may have any name.

    A source ends within its target by less than its smallest document that could still be taken, as far as PASSES passes reach:
    each fills what the one before left with the documents that fit it.
    """
    stored = _stored(docs, seed, whole)
    light = _drawn(stored)
    classes = materialize(
        stored.groupBy("__s", _level(F.col("__size")).alias("__l")).agg(F.sum("__size").alias("words")), "classes")
    sizes = classes.groupBy("__s").agg(F.sum("words").alias("source_size"))
    rates = materialize(_rates(classes.join(source_targets(sizes), "__s")), "rates")
    ranked = _units(light, broadcast_if_small(rates, SMALL_ROWS))
    told = materialize(
        classes.join(rates, ["__s", "__l"]).groupBy("__s").agg(
            F.round(F.max("target") - F.sum(F.floor("e") * F.col("words"))).cast("long").alias("gap0")),
        "gaps")

    def taken(unit: Column, n: int) -> Column:
        """Whether one of the first n passes takes the unit."""
        found = F.lit(False)
        for k in range(n):
            fits = (unit < F.col(f"edge{k}")) | (unit <= F.col(f"cut{k}"))
            found = found | F.coalesce(fits & (F.col("__size") <= F.col(f"gap{k}")) if k else fits, F.lit(False))
        return found

    for n in range(PASSES):
        units = ranked.select("__s", "__size", F.explode("__units").alias("v"))
        if n:
            units = units.join(broadcast_if_small(told, SMALL_ROWS), "__s").where(~taken(F.col("v"), n) & (F.col("__size") <= F.col(f"gap{n}")))
        cut = _cut(units.select("__s", "v", F.col("__size").alias("words")), told.select("__s", F.col(f"gap{n}").alias("budget")))
        cut = cut.select("__s", F.col("edge").alias(f"edge{n}"), F.col("cut").alias(f"cut{n}"), F.col("got"))
        told = materialize(told.join(cut, "__s", "left").withColumn(
            f"gap{n + 1}", F.col(f"gap{n}") - F.coalesce("got", F.lit(0))).drop("got"), "gaps")
    full = ranked.join(broadcast_if_small(told, SMALL_ROWS), "__s")
    copies = F.col("__whole") + F.size(F.filter("__units", lambda unit: taken(unit, PASSES)))
    return full.select("doc", "__size", "source_size", "target", copies.cast("int").alias("__copies"))


def mixed_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row of ``docs``."""
    return plan(docs.select("doc_id", "source", "text"), whole=False).select(
        F.col("doc.doc_id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
        (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns unchanged. Documents
    without words have nothing to weigh and stay once."""
    copies = F.when(F.col("__size") == 0, 1).otherwise(F.col("__copies"))
    repeated = plan(docs).select("doc", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH keyed AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS s,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix/' || COALESCE(doc_id::VARCHAR, '') || '/' || CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END || '/' || COALESCE(text, '')) AS key
  FROM documents),
sized AS (
  SELECT *, row_number() OVER () AS rn,
    (('0x' || substr(md5(key || '/' || (row_number() OVER (PARTITION BY key) - 1)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM keyed),
classes AS (SELECT s, length(bin(size)) AS l, SUM(size)::BIGINT AS words FROM sized GROUP BY ALL),
sizes AS (SELECT s, SUM(words)::BIGINT AS source_size FROM classes GROUP BY s),
weighed AS (
  SELECT *, source_size * 3.0::DOUBLE AS top,
    ([5, 2, 1])[((row_number() OVER (ORDER BY s[1] DESC, s) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sizes),
shares AS (
  SELECT *, (SUM(source_size) OVER ()::DOUBLE - COALESCE(SUM(top) OVER f, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER f, 0)) AS share
  FROM weighed WINDOW f AS (ORDER BY top / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT s, source_size, LEAST(top, COALESCE(w * (SELECT arg_min(share, (top / w, s)) FROM shares WHERE top / w > share), top)) AS target
  FROM shares),
filled AS (
  SELECT c.*, source_size, target, 1.0::DOUBLE + l / 16.0::DOUBLE AS p FROM classes c JOIN targets USING (s)),
levels AS (
  SELECT *, (target - 3.0::DOUBLE * COALESCE(SUM(words) OVER b, 0)::DOUBLE) / NULLIF(SUM(p * words) OVER a, 0) AS c
  FROM filled WINDOW b AS (PARTITION BY s ORDER BY l DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY s ORDER BY l DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
chosen AS (SELECT s, arg_max(c, l) AS c FROM levels WHERE c * p < 3 GROUP BY s),
rates AS (
  SELECT v.s, l, words, source_size, target, GREATEST(0.0::DOUBLE, LEAST(3.0::DOUBLE, COALESCE(chosen.c * p, 3.0::DOUBLE))) AS e
  FROM levels v LEFT JOIN chosen USING (s)),
budget AS (SELECT s, round(MAX(target) - SUM(floor(e) * words))::BIGINT AS budget FROM rates GROUP BY s),
odds AS (
  SELECT d.*, r.source_size, r.target, floor(e) AS whole, e - floor(e) AS p,
    CASE WHEN e - floor(e) > 0 THEN u / (1 - u) * ((1 - (e - floor(e))) / (e - floor(e))) END AS q
  FROM sized d JOIN rates r ON d.s = r.s AND length(bin(d.size)) = r.l),
units AS (
  SELECT rn, s, size, q / (1 + q) / 4 AS v FROM odds WHERE p > 0 AND size > 0 UNION ALL
  SELECT rn, s, size, (z + u) / 4 FROM odds, range(1, 4) AS t(z) WHERE size > 0 AND whole + (p > 0)::INT + z <= 3),
one AS (SELECT units.*, budget, SUM(size) OVER (PARTITION BY units.s ORDER BY v) <= budget AS got FROM units JOIN budget USING (s)),
two AS (SELECT *, budget - COALESCE(SUM(size) FILTER (WHERE got) OVER (PARTITION BY s), 0) AS gap FROM one),
three AS (
  SELECT *, got OR (size <= gap AND SUM(size) FILTER (WHERE NOT got AND size <= gap) OVER (PARTITION BY s ORDER BY v) <= gap) AS got2 FROM two),
four AS (SELECT *, budget - COALESCE(SUM(size) FILTER (WHERE got2) OVER (PARTITION BY s), 0) AS gap2 FROM three),
five AS (
  SELECT *, got2 OR (size <= gap2 AND SUM(size) FILTER (WHERE NOT got2 AND size <= gap2) OVER (PARTITION BY s ORDER BY v) <= gap2) AS got3 FROM four),
more AS (SELECT rn, count(*) FILTER (WHERE got3) AS more FROM five GROUP BY rn)
SELECT doc_id, size, source_size, target, (size * (whole + COALESCE(more, 0)))::BIGINT AS taken, (whole + COALESCE(more, 0))::INT AS copies
FROM odds LEFT JOIN more USING (rn)
"""
