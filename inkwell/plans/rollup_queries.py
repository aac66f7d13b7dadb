"""Roll-ups of scored runs: blocks for each run and slice, tables over seeds, pooled sets, error lists and coverage.

The scored rows are derived: three seeds judge every document, with types, a target span and a value span on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import spans as S
from inkwell.functions import text as T
from inkwell.plans.catalogue import query
from inkwell.session import table

KINDS = ("de", "en", "es", "fr")
#: Columns by expressions that Spark and DuckDB read alike; h decides what a seed gets wrong.
_BASE = {
    "doc_id": "doc_id", "seed": "seed", "source": "source", "n_chars": "length(text)", "human": "doc_id % 3 = 0", "complete": "doc_id % 10 <> 9", "accented": "{ACCENTED}",
    "h": "(doc_id * 7 + seed * 13) % 20", "gold_type": "lang",
    "gs": "CASE WHEN doc_id % 6 <> 0 THEN doc_id % 30 END", "vs": "CASE WHEN doc_id % 5 <> 0 THEN 40 + doc_id % 11 END",
}
_NEXT = {
    "pred_type": "CASE WHEN h < 3 THEN 'fr' WHEN h = 3 THEN 'de' ELSE gold_type END", "ge": "gs + 5", "ve": "vs + 3 + doc_id % 4",
    "ps": "CASE h WHEN 4 THEN NULL WHEN 5 THEN gs + 1 WHEN 6 THEN COALESCE(gs, 3) ELSE gs END", "qs": "CASE h WHEN 7 THEN NULL WHEN 8 THEN vs + 1 WHEN 9 THEN COALESCE(vs, 50) WHEN 10 THEN vs + 20 ELSE vs END",
}
_LAST = {"pe": "ps + 5", "qe": "qs + 3 + doc_id % 4"}
_FLAGS = {
    "type_ok": "gold_type IS NOT DISTINCT FROM pred_type", "target_ok": "gs IS NOT DISTINCT FROM ps AND ge IS NOT DISTINCT FROM pe", "value_ok": "vs IS NOT DISTINCT FROM qs AND ve IS NOT DISTINCT FROM qe"}


def _steps(accented: str) -> list[str]:
    pick = lambda m: ", ".join(f"{v.replace('{ACCENTED}', accented)} AS {k}" for k, v in m.items())
    return [pick(_BASE), "*, " + pick(_NEXT), "*, " + pick(_LAST), "*, " + pick(_FLAGS)]


def _nested(start: str, accented: str) -> str:
    for step in _steps(accented):
        start = f"(SELECT {step} FROM {start})"
    return start


SCORED = "r AS (SELECT * FROM " + _nested("(SELECT *, unnest([1, 2, 3]) AS seed FROM documents)", r"regexp_matches(text, '[^\x00-\x7F]')") + ")"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as judged under each seed."""
    rows = table(spark, sf_dir, "documents").withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("is_accented", T.accented(F.col("text")))
    for step, columns in zip((_BASE, _NEXT, _LAST), (None, "*", "*"), strict=True):
        rows = rows.selectExpr(*([columns] if columns else []), *[f"{v.replace('{ACCENTED}', 'is_accented')} AS {k}" for k, v in step.items()])
    same = lambda *pairs: [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]
    target, value = same(("gs", "ps"), ("ge", "pe")), same(("vs", "qs"), ("ve", "qe"))
    return rows.withColumns({"type_ok": same(("gold_type", "pred_type"))[0], "target_ok": target[0] & target[1], "value_ok": value[0] & value[1]})


def rate(test: Column) -> Column:
    """The share of rows that pass; null without rows."""
    return F.avg(test.cast("int"))


def span_prf(gs: str, ge: str, ps: str, pe: str) -> dict[str, Column]:
    """Precision, recall and F1 of spans that are there; 0 where a ratio has no denominator."""
    hit = F.count_if((F.col(gs) == F.col(ps)) & (F.col(ge) == F.col(pe)))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"precision": zero(hit, F.count(ps)), "recall": zero(hit, F.count(gs)), "f1": zero(2 * hit, F.count(ps) + F.count(gs))}


_PRF = {"precision": "COALESCE({h} / NULLIF(count({p}s), 0), 0)", "recall": "COALESCE({h} / NULLIF(count({g}s), 0), 0)", "f1": "COALESCE(2 * {h} / NULLIF(count({p}s) + count({g}s), 0), 0)"}


def _prf_sql(g: str, p: str, name: str) -> str:
    return _PRF[name].format(h=f"count(*) FILTER (WHERE {g}s = {p}s AND {g}e = {p}e)", g=g, p=p) + "::DOUBLE"


def by_class(rows: DataFrame, *by: str) -> DataFrame:
    """(by, label, support, n_pred, precision, recall, f1) of each class that occurs on either side."""
    sides = rows.select(*by, F.explode(F.array(F.struct(F.col("gold_type").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("hit")),
                                               F.struct(F.col("pred_type").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.col("type_ok").cast("int").alias("hit")))).alias("x")).select(*by, "x.*")
    told = sides.groupBy(*by, "label").agg(F.sum("g").alias("support"), F.sum("p").alias("n_pred"), F.sum("hit").alias("tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return told.select(*by, "label", "support", "n_pred", zero(F.col("tp"), F.col("n_pred")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"),
                       zero(2 * F.col("tp"), F.col("support") + F.col("n_pred")).alias("f1"))


def _class_sql(by: str) -> str:
    return f"""k AS (SELECT {by}, label, SUM(g)::BIGINT AS support, SUM(p)::BIGINT AS n_pred, SUM(hit) AS tp FROM (
  SELECT {by}, gold_type AS label, 1 AS g, 0 AS p, 0 AS hit FROM r UNION ALL SELECT {by}, pred_type, 0, 1, type_ok::INT FROM r) GROUP BY {by}, label),
c AS (SELECT {by}, label, support, n_pred, COALESCE(tp / NULLIF(n_pred, 0), 0)::DOUBLE AS "precision", COALESCE(tp / NULLIF(support, 0), 0)::DOUBLE AS recall, COALESCE(2 * tp / NULLIF(support + n_pred, 0), 0)::DOUBLE AS f1 FROM k)"""


@query(f"""WITH {SCORED}, {_class_sql("seed")}, m AS (SELECT seed, avg(f1) FILTER (WHERE support > 0) AS macro_f1 FROM c GROUP BY seed),
b AS (SELECT seed, count(*) AS n, avg(type_ok::INT) AS type_accuracy, avg(target_ok::INT) AS target_exact, {_prf_sql("g", "p", "f1")} AS target_f1, avg((type_ok AND target_ok)::INT) AS joint FROM r GROUP BY seed)
SELECT seed, n, round(type_accuracy, 9) AS type_accuracy, round(macro_f1, 9) AS type_macro_f1, round(target_exact, 9) AS target_exact, round(target_f1, 9) AS target_f1, round(joint, 9) AS joint,
  round((COALESCE(macro_f1, 0) + COALESCE(target_f1, 0)) / 2, 9) AS selection FROM b JOIN m USING (seed)""")
def run_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline block of each run and the score that selects among runs."""
    rows = scored(spark, sf_dir)
    macro = by_class(rows, "seed").where("support > 0").groupBy("seed").agg(F.avg("f1").alias("macro_f1"))
    told = rows.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("type_ok")).alias("type_accuracy"), rate(F.col("target_ok")).alias("target_exact"), span_prf("gs", "ge", "ps", "pe")["f1"].alias("target_f1"),
        rate(F.col("type_ok") & F.col("target_ok")).alias("joint")).join(macro, "seed")
    return told.select("seed", "n", *[F.round(c, 9).alias(a) for c, a in (("type_accuracy",) * 2, ("macro_f1", "type_macro_f1"), ("target_exact",) * 2, ("target_f1",) * 2, ("joint",) * 2)],
                       F.round((F.coalesce("macro_f1", F.lit(0.0)) + F.coalesce("target_f1", F.lit(0.0))) / 2, 9).alias("selection"))


@query(f"""WITH {SCORED}, {_class_sql("seed")} SELECT label, round(avg("precision"), 9) AS "precision", round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, CASE WHEN min(support) = max(support) THEN min(support) END AS support, round(avg(n_pred), 9) AS n_pred FROM c GROUP BY label""")
def per_class_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class metrics averaged over runs; the support, which all runs must share, else null."""
    c = by_class(scored(spark, sf_dir), "seed")
    return c.groupBy("label").agg(*[F.round(F.avg(m), 9).alias(m) for m in ("precision", "recall", "f1")], F.when(F.min("support") == F.max("support"), F.min("support")).alias("support"), F.round(F.avg("n_pred"), 9).alias("n_pred"))


@query(f"""WITH {SCORED}, g(gold_type) AS (VALUES ('de'), ('en'), ('es'), ('fr')), p(pred_type) AS (VALUES ('de'), ('en'), ('es'), ('fr'))
SELECT g.gold_type, p.pred_type, count(r.doc_id) AS n FROM g CROSS JOIN p LEFT JOIN r USING (gold_type, pred_type) GROUP BY ALL""")
def summed_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion cells summed over runs, zeros included."""
    cells = spark.createDataFrame([(a, b) for a in KINDS for b in KINDS], "gold_type string, pred_type string")
    told = scored(spark, sf_dir).groupBy("gold_type", "pred_type").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(told, ["gold_type", "pred_type"], "left").select("gold_type", "pred_type", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {SCORED}, s AS (SELECT seed, unnest(['accented', 'source']) AS slice, unnest([accented::VARCHAR, COALESCE(source, 'unknown')]) AS value, type_ok, target_ok, gs, ge, ps, pe FROM r),
b AS (SELECT slice, value, seed, count(*) AS n, avg(type_ok::INT) AS acc, avg(target_ok::INT) AS exact, {_prf_sql("g", "p", "f1")} AS f1 FROM s GROUP BY ALL)
SELECT slice, value, CASE WHEN min(n) = max(n) THEN min(n) END AS n, count(*) AS n_runs, round(avg(acc), 9) AS type_accuracy, round(avg(exact), 9) AS span_exact, round(avg(f1), 9) AS span_f1 FROM b GROUP BY slice, value""")
def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over runs by slice and value; a missing value is unknown."""
    told = scored(spark, sf_dir).withColumn("x", F.explode(F.array(
        F.struct(F.lit("accented").alias("slice"), F.col("accented").cast("string").alias("value")), F.struct(F.lit("source").alias("slice"), F.coalesce("source", F.lit("unknown")).alias("value")))))
    b = told.groupBy("x.slice", "x.value", "seed").agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("type_ok")).alias("acc"), rate(F.col("target_ok")).alias("exact"), span_prf("gs", "ge", "ps", "pe")["f1"].alias("f1"))
    return b.groupBy("slice", "value").agg(
        F.when(F.min("n") == F.max("n"), F.min("n")).alias("n"), F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("acc"), 9).alias("type_accuracy"), F.round(F.avg("exact"), 9).alias("span_exact"), F.round(F.avg("f1"), 9).alias("span_f1"))


def value_block(rows: DataFrame, *by: str) -> DataFrame:
    """The block of a value head: exactness overall and where there is a value, span metrics, errors, all together."""
    prf = span_prf("vs", "ve", "qs", "qe")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(rate(F.col("value_ok")), 9).alias("exact"), F.round(F.avg(F.when(F.col("vs").isNotNull(), F.col("value_ok").cast("int"))), 9).alias("present_accuracy"),
        *[F.round(v, 9).alias(f"span_{k}") for k, v in prf.items()], F.round(rate(F.col("type_ok") & F.col("target_ok") & F.col("value_ok")), 9).alias("full_joint"), F.count_if(~F.col("value_ok")).alias("n_errors"),
        F.count_if(F.col("type_ok")).alias("type_correct"), F.count_if(F.col("target_ok")).alias("target_correct"), F.count_if(F.col("type_ok") & F.col("target_ok")).alias("joint_correct"))


_BLOCK = f"""count(*) AS n, round(avg(value_ok::INT), 9) AS exact, round(avg(value_ok::INT) FILTER (WHERE vs IS NOT NULL), 9) AS present_accuracy,
  round({_prf_sql("v", "q", "precision")}, 9) AS span_precision, round({_prf_sql("v", "q", "recall")}, 9) AS span_recall, round({_prf_sql("v", "q", "f1")}, 9) AS span_f1,
  round(avg((type_ok AND target_ok AND value_ok)::INT), 9) AS full_joint, count(*) FILTER (WHERE NOT value_ok) AS n_errors,
  count(*) FILTER (WHERE type_ok) AS type_correct, count(*) FILTER (WHERE target_ok) AS target_correct, count(*) FILTER (WHERE type_ok AND target_ok) AS joint_correct"""


@query(f"WITH {SCORED} SELECT seed, {_BLOCK} FROM r WHERE complete GROUP BY seed")
def value_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value block of each run over complete rows."""
    return value_block(scored(spark, sf_dir).where("complete"), "seed")


@query(f"""WITH {SCORED}, w AS (SELECT *, CASE WHEN human THEN 'human' ELSE 'rule' END AS provenance FROM r WHERE complete) SELECT COALESCE(provenance, 'pooled') AS provenance, {_BLOCK} FROM w GROUP BY GROUPING SETS ((), (provenance))""")
def provenance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value block by provenance, and pooled over all runs."""
    rows = scored(spark, sf_dir).where("complete").withColumn("provenance", F.when(F.col("human"), "human").otherwise("rule"))
    return value_block(rows.union(rows.withColumn("provenance", F.lit("pooled"))), "provenance")


_SLICES = "list_filter([CASE WHEN vs IS NULL THEN 'no_amount' END, CASE WHEN NOT accented THEN 'unaccented' END, CASE WHEN ve - vs > 4 THEN 'long' END, CASE WHEN vs IS NOT NULL AND (vs, ve) NOT IN (SELECT (vs, ve) FROM seen) THEN 'unseen' END], lambda x: x IS NOT NULL)"


def value_slices(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``rows`` with the names of the slices that each belongs to; unseen where no row of ``seen`` has its value."""
    known = seen.select("vs", "ve").distinct().withColumn("known", F.lit(True))
    told = rows.join(known, ["vs", "ve"], "left")
    return told.withColumn("slices", F.array_compact(F.array(
        F.when(F.col("vs").isNull(), "no_amount"), F.when(~F.col("accented"), "unaccented"), F.when(F.col("ve") - F.col("vs") > 4, "long"),
        F.when(F.col("vs").isNotNull() & F.col("known").isNull(), "unseen"))))


_SEEN = "seen AS (SELECT DISTINCT vs, ve FROM r WHERE complete AND doc_id % 2 = 1 AND doc_id % 11 < 6 AND vs IS NOT NULL)"


@query(f"""WITH {SCORED}, {_SEEN}, m AS (SELECT seed, value_ok, unnest({_SLICES}) AS slice FROM r WHERE complete), b AS (SELECT slice, seed, count(*) AS n, avg(value_ok::INT) AS exact FROM m GROUP BY ALL)
SELECT d.slice, max(n) FILTER (WHERE seed = 1) AS n, round(max(exact) FILTER (WHERE seed = 1), 9) AS seed_1, round(max(exact) FILTER (WHERE seed = 2), 9) AS seed_2, round(max(exact) FILTER (WHERE seed = 3), 9) AS seed_3,
  CASE WHEN count(exact) = 3 THEN round(avg(exact), 9) END AS mean, CASE WHEN count(exact) = 3 THEN round(stddev_samp(exact), 9) END AS std
FROM (VALUES ('no_amount'), ('unaccented'), ('long'), ('unseen'), ('slang')) d(slice) LEFT JOIN b USING (slice) GROUP BY d.slice""")
def value_slice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value exactness by slice and seed with mean and spread; null where a seed has no row of the slice."""
    rows = scored(spark, sf_dir).where("complete")
    seen = rows.where("doc_id % 2 = 1 and doc_id % 11 < 6 and vs is not null")
    b = value_slices(rows, seen).select("seed", "value_ok", F.explode("slices").alias("slice")).groupBy("slice", "seed").agg(F.count(F.lit(1)).alias("n"), rate(F.col("value_ok")).alias("exact"))
    at = lambda c, k: F.max(F.when(F.col("seed") == k, F.col(c)))
    told = b.groupBy("slice").agg(at("n", 1).alias("n"), *[F.round(at("exact", k), 9).alias(f"seed_{k}") for k in (1, 2, 3)], F.when(F.count("exact") == 3, F.round(F.avg("exact"), 9)).alias("mean"), F.when(F.count("exact") == 3, F.round(F.stddev_samp("exact"), 9)).alias("std"))
    return spark.createDataFrame([(s,) for s in ("no_amount", "unaccented", "long", "unseen", "slang")], "slice string").join(told, "slice", "left")


@query(f"""WITH {SCORED}, s AS (SELECT unnest(CASE WHEN accented THEN ['all', 'accented'] ELSE ['all', 'unaccented'] END) AS slice, seed, type_ok, target_ok, doc_id FROM r),
c AS (SELECT slice, seed, count(*) AS n, count(*) FILTER (WHERE type_ok) AS b_type, count(*) FILTER (WHERE type_ok OR doc_id % 9 = 0) AS a_type, count(*) FILTER (WHERE type_ok AND target_ok) AS b_joint, count(*) FILTER (WHERE (type_ok AND target_ok) OR doc_id % 9 = 0) AS a_joint FROM s GROUP BY ALL)
SELECT slice, min(n) AS n, SUM(b_type - a_type)::BIGINT AS type_drop, round(avg(b_type) - avg(a_type), 9) AS type_delta, round(avg(b_joint) - avg(a_joint), 9) AS joint_delta, min(b_joint - a_joint) AS worst_seed, -SUM(b_joint - a_joint) * 10 <= SUM(n) AS within FROM c GROUP BY slice""")
def regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' right answers by slice over the seeds: drops in whole notes, mean changes, and a limit of a tenth without division."""
    rows = scored(spark, sf_dir).withColumn("slice", F.explode(F.array(F.lit("all"), F.when(F.col("accented"), "accented").otherwise("unaccented"))))
    lucky, joint = F.col("doc_id") % 9 == 0, F.col("type_ok") & F.col("target_ok")
    c = rows.groupBy("slice", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("type_ok").alias("b_type"), F.count_if(F.col("type_ok") | lucky).alias("a_type"), F.count_if(joint).alias("b_joint"), F.count_if(joint | lucky).alias("a_joint"))
    gap = F.col("b_joint") - F.col("a_joint")
    return c.groupBy("slice").agg(
        F.min("n").alias("n"), F.sum(F.col("b_type") - F.col("a_type")).alias("type_drop"), F.round(F.avg("b_type") - F.avg("a_type"), 9).alias("type_delta"), F.round(F.avg("b_joint") - F.avg("a_joint"), 9).alias("joint_delta"),
        F.min(gap).alias("worst_seed"), (-F.sum(gap) * 10 <= F.sum("n")).alias("within"))


@query(f"""WITH {SCORED} SELECT seed, doc_id, 'type' AS kind, gold_type AS gold, pred_type AS pred FROM r WHERE NOT type_ok UNION ALL
SELECT seed, doc_id, 'span', gs || ':' || ge, ps || ':' || pe FROM r WHERE NOT target_ok UNION ALL SELECT seed, doc_id, 'value', vs || ':' || ve, qs || ':' || qe FROM r WHERE complete AND NOT value_ok""")
def failure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every run by kind, with both sides."""
    span = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(":"), F.col(b).cast("string"))
    one = lambda kind, test, gold, pred: F.when(test, F.struct(F.lit(kind).alias("kind"), gold.alias("gold"), pred.alias("pred")))
    kinds = F.array_compact(F.array(
        one("type", ~F.col("type_ok"), F.col("gold_type"), F.col("pred_type")), one("span", ~F.col("target_ok"), span("gs", "ge"), span("ps", "pe")),
        one("value", F.col("complete") & ~F.col("value_ok"), span("vs", "ve"), span("qs", "qe"))))
    return scored(spark, sf_dir).select("seed", "doc_id", F.inline(kinds))


@query(f"""WITH {SCORED} SELECT gold_type || ' > ' || pred_type AS cell, count(*) AS n FROM r WHERE gold_type IN ('de', 'fr') AND pred_type IN ('de', 'fr') AND NOT type_ok GROUP BY cell""")
def pair_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions within two classes, cells that occur only."""
    pair = scored(spark, sf_dir).where("gold_type in ('de', 'fr') and pred_type in ('de', 'fr') and not type_ok")
    return pair.groupBy(F.concat_ws(" > ", "gold_type", "pred_type").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORED} SELECT d.label, count(r.doc_id) AS n, count(*) FILTER (WHERE type_ok) AS hits FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) d(label) LEFT JOIN r ON gold_type = label GROUP BY d.label""")
def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and hits of each class, zeros included."""
    told = scored(spark, sf_dir).groupBy(F.col("gold_type").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if("type_ok").alias("hits"))
    return spark.createDataFrame([(k,) for k in (*KINDS, "it")], "label string").join(told, "label", "left").fillna(0, ["n", "hits"])


@query(f"""WITH {SCORED} SELECT gold_type, pred_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, gold_type, pred_type)::INT AS rank FROM r WHERE NOT type_ok GROUP BY gold_type, pred_type QUALIFY rank <= 12""")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve commonest confusions: a top-k over class pairs."""
    told = scored(spark, sf_dir).where("not type_ok").groupBy("gold_type", "pred_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "gold_type", "pred_type").limit(12)
    return told.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "gold_type", "pred_type")))  # twelve rows


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS most,
  max(CASE WHEN i = ((n * 95) // 100) + 1 THEN l_extendedprice END) AS p95_floor FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY l_returnflag""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by interpolation and by floored rank. The value at a rank comes from counts of values, not from a sort of the group."""
    rows = table(spark, sf_dir, "lineitem")
    told = rows.groupBy("l_returnflag").agg(
        F.round(F.percentile("l_extendedprice", 0.5), 6).alias("p50"), F.round(F.percentile("l_extendedprice", 0.95), 6).alias("p95"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.max("l_extendedprice").alias("most"), F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("l_returnflag").orderBy("l_extendedprice"))
    at = counts.withColumn("upto", upto).join(told.select("l_returnflag", "n"), "l_returnflag").where(F.col("upto") >= F.floor(F.col("n") * 95 / 100) + 1)
    return told.drop("n").join(at.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("p95_floor")), "l_returnflag")


@query(r"""WITH l AS (SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS head FROM documents), f AS (SELECT *, CASE WHEN regexp_matches(head, '\d') THEN 'number' WHEN regexp_matches(head, '[!?]') THEN 'mark' ELSE 'plain' END AS family FROM l)
SELECT source, family, lang, count(*) AS n, list_sort(list(doc_id))[1:6] AS examples FROM f GROUP BY ALL""")
def family_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, family and language with the six least ids: kept small by a top-n before they meet."""
    head = F.get(F.split("text", "\n"), F.lit(0))
    f = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(head.rlike(r"\d"), "number").when(head.rlike("[!?]"), "mark").otherwise("plain").alias("family"))
    by = ["source", "family", "lang"]
    first = f.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))).where("i <= 6").groupBy(*by).agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    return f.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(first, by)


@query(r"""WITH m AS (SELECT doc_id, lang, regexp_replace(lower(text), '\d+', 'n', 'g') AS mask FROM documents) SELECT sha256(mask) AS mask_id, count(*) AS n, count(DISTINCT lang) AS n_langs, min(doc_id) AS first_doc FROM m GROUP BY mask HAVING count(*) > 1""")
def repeated_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal once numbers are masked."""
    m = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.regexp_replace(F.lower("text"), r"\d+", "n"), 256).alias("mask_id"))
    return m.groupBy("mask_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_langs"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(r"""SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '^[A-Z]')) - count(*) FILTER (WHERE NOT regexp_matches(text, '^[A-Z]')) AS balance FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def capital_first_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin with a capital less those that don't."""
    up = F.col("text").rlike("^[A-Z]")
    return table(spark, sf_dir, "documents").where("text is not null").groupBy("lang").agg((F.count_if(up) - F.count_if(~up)).alias("balance"))


@query("""SELECT 'all' AS dimension, 'all' AS value, count(*) AS n FROM documents UNION ALL SELECT 'lang', COALESCE(lang, 'none'), count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'source', COALESCE(source, 'none'), count(*) FROM documents GROUP BY ALL
UNION ALL SELECT 'lang and source', COALESCE(lang, 'none') || '/' || COALESCE(source, 'none'), count(*) FROM documents GROUP BY ALL""")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested counts of a manifest in long form, by one pass over grouping sets."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("l"), F.coalesce("source", F.lit("none")).alias("s"))
    g = d.groupingSets([[], [F.col("l")], [F.col("s")], [F.col("l"), F.col("s")]], F.col("l"), F.col("s")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    named = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "lang").when(F.col("g") == 2, "source").otherwise("lang and source")
    return g.select(named.alias("dimension"), F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("l")).when(F.col("g") == 2, F.col("s")).otherwise(F.concat_ws("/", "l", "s")).alias("value"), "n")


_ERRORS = "list_filter([CASE WHEN NOT type_ok THEN 'type' END, CASE WHEN NOT target_ok THEN 'target' END, CASE WHEN NOT value_ok THEN 'value' END], lambda x: x IS NOT NULL)"


@query(f"""WITH {SCORED}, e AS (SELECT *, doc_id % 8 <> 0 AS labelled, {_ERRORS} AS errors FROM r WHERE seed = 1),
t AS (SELECT COALESCE(source, 'all') AS source, count(*) AS queued, count(*) FILTER (WHERE labelled) AS labelled, count(*) FILTER (WHERE NOT labelled) AS pending, count(*) FILTER (WHERE labelled AND len(errors) > 0) AS wrong,
  round(count(*) FILTER (WHERE labelled AND len(errors) > 0) / NULLIF(count(*) FILTER (WHERE labelled), 0), 9) AS error_rate, COALESCE(SUM(len(errors)) FILTER (WHERE labelled), 0)::BIGINT AS kinds FROM e GROUP BY GROUPING SETS ((), (source)))
SELECT *, CASE WHEN pending > 0 AND wrong = 0 THEN 'pending' WHEN wrong * 4 > labelled THEN 'review' ELSE 'accept' END AS verdict FROM t""")
def review_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued, labelled, pending and wrong rows of each stratum and of all, with a verdict."""
    errors = F.array_compact(F.array(F.when(~F.col("type_ok"), "type"), F.when(~F.col("target_ok"), "target"), F.when(~F.col("value_ok"), "value")))
    e = scored(spark, sf_dir).where("seed = 1").select(F.explode(F.array("source", F.lit("all"))).alias("source"), (F.col("doc_id") % 8 != 0).alias("labelled"), F.size(errors).alias("k"))
    wrong = F.count_if(F.col("labelled") & (F.col("k") > 0))
    t = e.groupBy("source").agg(
        F.count(F.lit(1)).alias("queued"), F.count_if("labelled").alias("labelled"), F.count_if(~F.col("labelled")).alias("pending"), wrong.alias("wrong"), F.round(F.try_divide(wrong, F.count_if("labelled")), 9).alias("error_rate"),
        F.sum(F.when(F.col("labelled"), F.col("k")).otherwise(0)).alias("kinds"))
    return t.withColumn("verdict", F.when((F.col("pending") > 0) & (F.col("wrong") == 0), "pending").when(F.col("wrong") * 4 > F.col("labelled"), "review").otherwise("accept"))


@query(f"""WITH {SCORED}, d AS (SELECT unnest(['type', 'length', 'accent']) AS dimension, unnest([gold_type, CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END, CASE WHEN accented THEN 'yes' ELSE 'no' END]) AS value, complete, human, vs FROM r WHERE seed = 1)
SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE human) AS human, count(vs) AS with_value FROM d GROUP BY ALL""")
def dimension_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each value of each dimension, how many rows meet each predicate."""
    one = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    d = scored(spark, sf_dir).where("seed = 1").withColumn("x", F.explode(F.array(
        one("type", F.col("gold_type")), one("length", F.when(F.col("n_chars") < 500, "short").otherwise("long")), one("accent", F.when(F.col("accented"), "yes").otherwise("no")))))
    return d.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("complete"), F.count_if("human").alias("human"), F.count("vs").alias("with_value"))


_PATTERN = r"regexp_replace(lower(string_split(text, ' ')[1]), '\d+', 'n', 'g')"


@query(rf"""WITH p AS (SELECT doc_id, lang, {_PATTERN} AS pattern, doc_id % 5 = 0 AS test FROM documents WHERE text IS NOT NULL), t AS (SELECT DISTINCT pattern FROM p WHERE NOT test)
SELECT lang, pattern, count(*) AS n, count(*) FILTER (WHERE test) AS n_test, pattern IN (SELECT pattern FROM t) AS seen, CASE WHEN count(*) >= 20 THEN 'covered' WHEN count(*) >= 5 THEN 'thin' ELSE 'rare' END AS status FROM p GROUP BY lang, pattern""")
def pattern_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each surface pattern occurs by language, whether training holds it, and how well it is covered."""
    pattern = F.regexp_replace(F.lower(F.get(F.split("text", " "), F.lit(0))), r"\d+", "n")
    p = table(spark, sf_dir, "documents").where("text is not null").select("lang", pattern.alias("pattern"), (F.col("doc_id") % 5 == 0).alias("test"))
    told = p.groupBy("lang", "pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if("test").alias("n_test"))
    seen = told.where("n > n_test").select("pattern").distinct().withColumn("seen", F.lit(True))
    return told.join(seen, "pattern", "left").select("lang", "pattern", "n", "n_test", F.coalesce("seen", F.lit(False)).alias("seen"), F.when(F.col("n") >= 20, "covered").when(F.col("n") >= 5, "thin").otherwise("rare").alias("status"))


@query(rf"""WITH w AS (SELECT lang, regexp_matches(text, '[^\x00-\x7F]') AS accented, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark)
SELECT lang, accented, count(*) AS n_words, round(avg(length(w.word)), 9) AS mean_length, round(SUM((length(w.word) + 3) // 4) / count(*), 9) AS pieces_a_word, count(*) FILTER (WHERE v.word IS NULL) AS n_unseen FROM w LEFT JOIN v ON lower(w.word) = v.word GROUP BY ALL""")
def fragmentation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, pieces of four letters for each word, and words that a vocabulary lacks, by language and accent."""
    w = table(spark, sf_dir, "documents").select("lang", T.accented(F.col("text")).alias("accented"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("words"))
    w = w.select("lang", "accented", F.explode("words").alias("word"))  # the text is tested once, before its words part
    counted = w.groupBy("lang", "accented", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("c"))  # a hot word is one row from here on
    v = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).select(F.lower("w").alias("word")).distinct().withColumn("known", F.lit(True))
    told = counted.join(v, "word", "left").withColumn("n", F.length("word"))
    return told.groupBy("lang", "accented").agg(
        F.sum("c").alias("n_words"), F.round(F.sum(F.col("c") * F.col("n")) / F.sum("c"), 9).alias("mean_length"), F.round(F.sum(F.col("c") * F.floor((F.col("n") + 3) / 4)) / F.sum("c"), 9).alias("pieces_a_word"),
        F.sum(F.when(F.col("known").isNull(), F.col("c")).otherwise(0)).alias("n_unseen"))


@query(rf"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '\S+'))) AS word FROM documents), c AS (SELECT CASE WHEN regexp_matches(word, '^\d') THEN 'number' WHEN regexp_matches(word, '[^\x00-\x7F]') THEN 'accented' WHEN regexp_matches(word, '^[a-z]+$') THEN 'plain' ELSE 'mixed' END AS category, word, count(*) AS n FROM w GROUP BY ALL)
SELECT category, count(*) AS n_types, SUM(n)::BIGINT AS n_uses, count(*) FILTER (WHERE n = 1) AS n_once, max(n) AS most FROM c GROUP BY category""")
def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word types, uses and hapaxes by category."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("w")).select(F.lower("w").alias("word"))
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    x = F.col("word")
    kind = F.when(x.rlike(r"^\d"), "number").when(T.accented(x), "accented").when(x.rlike(r"^[a-z]+\z"), "plain").otherwise("mixed")
    return c.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("n_uses"), F.count_if(F.col("n") == 1).alias("n_once"), F.max("n").alias("most"))


@query(f"""WITH {SCORED}, m AS (SELECT avg(value_ok::INT) AS exact, avg(value_ok::INT) FILTER (WHERE vs IS NOT NULL) AS present, avg(value_ok::INT) FILTER (WHERE vs IS NULL) AS absent, count(*) FILTER (WHERE value_ok IS NULL) AS bad FROM r WHERE complete)
SELECT name, round(value, 9) AS value, threshold::DOUBLE AS threshold, COALESCE(value >= threshold - 1e-9, false) AS pass FROM (SELECT unnest(['exact', 'present', 'absent', 'invariance', 'nothing']) AS name, unnest([exact, present, absent, CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END, NULL]) AS value, unnest([0.75, 0.75, 0.9, 1.0, 0.5]) AS threshold FROM m)""")
def value_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks against a protocol; a missing value fails, and thresholds allow for rounding."""
    ok = F.col("value_ok").cast("int")
    m = scored(spark, sf_dir).where("complete").agg(
        F.avg(ok).alias("exact"), F.avg(F.when(F.col("vs").isNotNull(), ok)).alias("present"), F.avg(F.when(F.col("vs").isNull(), ok)).alias("absent"), F.count_if(ok.isNull()).alias("bad"))
    checks = [("exact", F.col("exact"), 0.75), ("present", F.col("present"), 0.75), ("absent", F.col("absent"), 0.9), ("invariance", F.when(F.col("bad") == 0, 1.0).otherwise(0.0), 1.0), ("nothing", F.lit(None).cast("double"), 0.5)]
    told = F.array(*[F.struct(F.lit(k).alias("name"), F.round(v, 9).alias("value"), F.lit(t).alias("threshold"), F.coalesce(v >= t - 1e-9, F.lit(False)).alias("pass")) for k, v, t in checks])
    return m.select(F.inline(told))


@query(f"""WITH {SCORED}, s AS (SELECT source, bool_or(NOT value_ok) AS escalate FROM r WHERE seed = 1 AND human GROUP BY source), i AS (SELECT r.doc_id, r.source FROM r JOIN s USING (source) WHERE seed = 1 AND escalate AND doc_id NOT IN (SELECT doc_id FROM labels))
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('stage:' || doc_id), doc_id)::INT AS position FROM i QUALIFY position <= 15""")
def escalation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled ids of the strata that escalate, the first fifteen of each in seeded order."""
    from inkwell.operators.sampling import quota

    r = scored(spark, sf_dir).where("seed = 1")
    bad = r.where("human").groupBy("source").agg(F.bool_or(~F.col("value_ok")).alias("escalate")).where("escalate").select("source")
    left = r.join(bad, "source").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti").select("source", "doc_id")
    return quota(left, "source", "doc_id", "stage", F.lit(15)).select("source", "doc_id", "position")


@query(f"""WITH {SCORED}, o AS (SELECT unnest(list_filter(['all', CASE WHEN vs IS NULL THEN 'none' ELSE 'some' END, CASE WHEN ve - vs > 4 THEN 'long' END], lambda x: x IS NOT NULL)) AS category, value_ok, vs, ve, qs, qe FROM r WHERE complete)
SELECT category, count(*) AS n, round(avg(value_ok::INT), 9) AS exact, round(avg(COALESCE(vs IS NOT DISTINCT FROM qs, false)::INT), 9) AS core_exact, round(avg(value_ok::INT) FILTER (WHERE vs IS NULL), 9) AS null_accuracy,
  SUM(CASE WHEN vs IS NOT NULL AND qs IS NOT NULL THEN greatest(0, least(ve, qe) - greatest(vs, qs)) ELSE 0 END)::BIGINT AS shared FROM o GROUP BY category""")
def value_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value exactness by category; a row may be in several."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("vs").isNull(), "none").otherwise("some"), F.when(F.col("ve") - F.col("vs") > 4, "long")))
    both = F.col("vs").isNotNull() & F.col("qs").isNotNull()
    return scored(spark, sf_dir).where("complete").withColumn("category", F.explode(kinds)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(rate(F.col("value_ok")), 9).alias("exact"), F.round(rate(F.col("vs").eqNullSafe(F.col("qs"))), 9).alias("core_exact"), F.round(F.avg(F.when(F.col("vs").isNull(), F.col("value_ok").cast("int"))), 9).alias("null_accuracy"),
        F.sum(F.when(both, S.overlap(F.col("vs"), F.col("ve"), F.col("qs"), F.col("qe"))).otherwise(0)).alias("shared"))
