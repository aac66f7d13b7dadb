"""Queries over metrics, aggregates, slices and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import arrays as A
from inkwell.functions import spans as S
from inkwell.operators import metrics as M
from inkwell.plans.catalogue import query
from inkwell.session import table

_PRED = """c AS (SELECT label, list_transform(range(1, 1 + any_value(len(embedding))), lambda i: 0.0) AS z FROM embeddings GROUP BY label),
pred AS (SELECT vec_id, label AS gold, (CASE WHEN embedding[1] + embedding[2] > 0 THEN label ELSE (label + 1) % 3 END)::INT AS pred FROM embeddings)"""
_RULE = """r AS (SELECT l.doc_id, quality, toxic, (length(text) >= 200)::INT AS rule, lang, source FROM labels l JOIN documents d USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived prediction beside each vector's label."""
    e = table(spark, sf_dir, "embeddings")
    up = F.get("embedding", 0) + F.get("embedding", 1) > 0
    return e.select("vec_id", F.col("label").alias("gold"), F.when(up, F.col("label")).otherwise((F.col("label") + 1) % 3).cast("int").alias("pred"))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside a rule's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.length("text") >= 200).cast("int").alias("rule"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


_CLASS_SQL = """k AS (SELECT label, SUM(tp)::BIGINT AS tp, SUM(g)::BIGINT AS support, SUM(p)::BIGINT AS predicted FROM (
  SELECT gold AS label, (gold = pred)::INT AS tp, 1 AS g, 0 AS p FROM pred UNION ALL SELECT pred, 0, 0, 1 FROM pred) GROUP BY label)"""


@query(f"""WITH {_PRED}, {_CLASS_SQL}
SELECT label, support, predicted, tp, COALESCE(tp / NULLIF(predicted, 0), 0)::DOUBLE AS precision, COALESCE(tp / NULLIF(support, 0), 0)::DOUBLE AS recall,
  COALESCE(2 * tp / NULLIF(predicted + support, 0), 0)::DOUBLE AS f1 FROM k""")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by class."""
    return M.per_class(M.confusion(predictions(spark, sf_dir), "gold", "pred"))


@query(f"""WITH {_PRED}, {_CLASS_SQL}
SELECT round(avg(2 * tp / (predicted + support)), 9) AS macro_f1_all, round(avg(2 * tp / (predicted + support)) FILTER (WHERE support > 0), 9) AS macro_f1_supported,
  (SELECT round(avg((gold = pred)::INT), 9) FROM pred) AS accuracy FROM k""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 over all and over supported classes, and accuracy."""
    told = M.per_class(M.confusion(predictions(spark, sf_dir), "gold", "pred"))
    return told.agg(
        F.round(F.avg("f1"), 9).alias("macro_f1_all"), F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 9).alias("macro_f1_supported"),
        F.round(F.sum("tp") / F.sum("support"), 9).alias("accuracy"))


_SPANS = """s AS (SELECT doc_id, lang, text, NULLIF(strpos(text, ' of '), 0) - 1 AS gs, NULLIF(strpos(text, ' of '), 0) + 3 AS ge,
  NULLIF(strpos(text, ' the '), 0) - 1 AS ps, NULLIF(strpos(text, ' the '), 0) + 3 AS pe FROM documents)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived gold and predicted spans in each document."""
    head = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    at = lambda word: F.nullif(F.locate(word, F.col("text")), F.lit(0))
    return head.select(
        "*", (at(" of ") - 1).alias("gs"), (at(" of ") + 3).alias("ge"), (at(" the ") - 1).alias("ps"), (at(" the ") + 3).alias("pe"))


@query(f"""WITH {_SPANS} SELECT lang, count(*) AS n, count(*) FILTER (WHERE gs IS NOT DISTINCT FROM ps AND ge IS NOT DISTINCT FROM pe) AS n_exact,
  count(*) FILTER (WHERE gs = ps AND ge = pe) AS tp, count(ps) AS n_pred, count(gs) AS n_gold,
  COALESCE(2 * count(*) FILTER (WHERE gs = ps AND ge = pe) / NULLIF(count(ps) + count(gs), 0), 0)::DOUBLE AS f1 FROM s GROUP BY lang""")
def span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-aware exact span match and F1."""
    hit = (F.col("gs") == F.col("ps")) & (F.col("ge") == F.col("pe"))
    return spans(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gs").eqNullSafe(F.col("ps")) & F.col("ge").eqNullSafe(F.col("pe"))).alias("n_exact"),
        F.count_if(hit).alias("tp"), F.count("ps").alias("n_pred"), F.count("gs").alias("n_gold")).withColumn("f1", M.f1(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


@query(f"""WITH {_SPANS} SELECT SUM(CASE WHEN gs IS NOT NULL AND ps IS NOT NULL THEN greatest(0, least(ge, pe) - greatest(gs, ps)) ELSE 0 END)::BIGINT AS shared, SUM(COALESCE(pe - ps, 0))::BIGINT AS predicted, SUM(COALESCE(ge - gs, 0))::BIGINT AS gold,
  2 * SUM(COALESCE(CASE WHEN gs IS NOT NULL AND ps IS NOT NULL THEN greatest(0, least(ge, pe) - greatest(gs, ps)) END, 0)) / (SUM(COALESCE(pe - ps, 0)) + SUM(COALESCE(ge - gs, 0))) AS f1
  FROM (SELECT gs, ge, ps, pe FROM s WHERE gs IS NOT NULL AND ps IS NOT NULL UNION ALL SELECT gs, ge, NULL, NULL FROM s WHERE ps IS NULL UNION ALL SELECT NULL, NULL, ps, pe FROM s WHERE gs IS NULL)""")
def char_overlap_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro F1 over shared characters of spans."""
    both = F.col("gs").isNotNull() & F.col("ps").isNotNull()
    shared = F.when(both, S.overlap(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe"))).otherwise(0)
    size = lambda a, b: F.coalesce(F.col(b) - F.col(a), F.lit(0))
    told = spans(spark, sf_dir).agg(
        F.sum(shared).alias("shared"), F.sum(size("ps", "pe")).alias("predicted"), F.sum(size("gs", "ge")).alias("gold"))
    return told.withColumn("f1", M.f1(F.col("shared"), F.col("predicted"), F.col("gold")))


_OUTCOMES = "CASE WHEN gs IS NULL AND ps IS NULL THEN 'correct_null' WHEN gs IS NULL THEN 'false' WHEN ps IS NULL THEN 'missed' WHEN gs = ps AND ge = pe THEN 'exact' WHEN least(ge, pe) > greatest(gs, ps) THEN 'partial' ELSE 'disjoint' END"


@query(f"""WITH {_SPANS}, o AS (SELECT {_OUTCOMES} AS outcome FROM s), d(outcome) AS (VALUES ('exact'), ('correct_null'), ('false'), ('missed'), ('partial'), ('disjoint'))
SELECT d.outcome, count(o.outcome) AS n FROM d LEFT JOIN o USING (outcome) GROUP BY d.outcome""")
def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled counts of the six span outcomes."""
    told = spans(spark, sf_dir).groupBy(S.outcome(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    dims = spark.createDataFrame([(x,) for x in ("exact", "correct_null", "false", "missed", "partial", "disjoint")], "outcome string")
    return dims.join(told, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_SPANS} SELECT doc_id, CASE WHEN gs IS NULL AND ps IS NULL THEN 'none' WHEN gs IS NULL THEN 'spurious' WHEN ps IS NULL THEN 'missing' WHEN gs = ps AND ge = pe THEN 'exact'
  WHEN ps <= gs AND pe >= ge THEN 'too_long' WHEN ps >= gs AND pe <= ge THEN 'too_short' WHEN ps < gs AND pe > gs THEN 'shifted_left' WHEN ps < ge AND pe > ge THEN 'shifted_right' ELSE 'elsewhere' END AS category FROM s""")
def span_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each predicted span lies to its gold one."""
    return spans(spark, sf_dir).select("doc_id", S.error_class(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe")).alias("category"))


@query(f"""WITH {_RULE} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS slice, COALESCE(lang, source, 'all') AS value,
  count(*) AS n, round(avg((quality = rule)::INT), 9) AS accuracy, SUM(toxic)::BIGINT AS n_toxic FROM r GROUP BY GROUPING SETS ((), (lang), (source))""")
def sliced_metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics overall and by each slice column in one pass."""
    rows = ruled(spark, sf_dir)
    told = rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(
        F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("quality") == F.col("rule")).cast("int")), 9).alias("accuracy"), F.sum("toxic").alias("n_toxic"))
    return told.select(
        F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("overall").alias("slice"),
        F.coalesce("lang", "source", F.lit("all")).alias("value"), "n", "accuracy", "n_toxic")


@query(r"""
WITH d AS (SELECT doc_id, quality, list_filter(['all', CASE WHEN length(text) < 500 THEN 'short' END, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'accented' END, CASE WHEN contains(text, '|') THEN 'bars' END], lambda x: x IS NOT NULL) AS s FROM documents JOIN labels USING (doc_id)),
e AS (SELECT unnest(s) AS slice, quality FROM d) SELECT slice, count(*) AS n, SUM(quality)::BIGINT AS n_good, round(avg(quality), 9) AS rate FROM e GROUP BY slice""")
def multi_slice_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row may be in several slices."""
    t = F.col("text")
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.length(t) < 500, "short"), F.when(t.rlike(r"[^\x00-\x7F]"), "accented"), F.when(t.contains("|"), "bars")))
    rows = table(spark, sf_dir, "documents").select("doc_id", slices.alias("s")).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.explode("s").alias("slice"), "quality").groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("n_good"), F.round(F.avg("quality"), 9).alias("rate"))


@query(f"""WITH {_RULE}, c AS (SELECT quality AS a, rule AS b, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT SUM(n) AS n, SUM(n) FILTER (WHERE a = b) AS s FROM c),
pe AS (SELECT SUM(x.n::DOUBLE * y.n) AS c FROM (SELECT a, SUM(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, SUM(n) AS n FROM c GROUP BY b) y ON a = b)
SELECT n::BIGINT AS n, round(s / n, 9) AS agreement, round((s / n - c / (n::DOUBLE * n)) / (1 - c / (n::DOUBLE * n)), 9) AS kappa FROM t, pe""")
def labeller_agreement_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement and Cohen's kappa of the labels with a rule."""
    told = M.kappa(M.confusion(ruled(spark, sf_dir), "quality", "rule"))
    return told.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("""SELECT l_linenumber AS seed, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY l_linenumber""")
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread by run."""
    x = "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("seed")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))


@query("""SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def crosstab_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by quality."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("unlabelled")
    return rows.withColumn("kind", kind).groupBy("lang").pivot("kind", ["good", "bad", "unlabelled"]).agg(F.count(F.lit(1))).na.fill(0)


@query(r"""
WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w)
SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' WHEN n <= 100 THEN '11-100' ELSE '101+' END AS bucket, count(*) AS n_words, SUM(n)::BIGINT AS n_tokens FROM c GROUP BY bucket""")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency of word frequencies in buckets."""
    counts = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 10, "4-10").when(n <= 100, "11-100").otherwise("101+")
    return counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"))


@query(r"""
WITH b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), d AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
SELECT w AS unseen FROM b ANTI JOIN d USING (w)""")
def vocab_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words that the corpus lacks."""
    vocabulary = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).select(F.lower("w").alias("w")).distinct()
    train = vocabulary(table(spark, sf_dir, "documents"))
    return vocabulary(table(spark, sf_dir, "benchmark")).join(train, "w", "left_anti").select(F.col("w").alias("unseen"))


@query("""SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag""")
def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearly interpolated percentiles."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        *[F.percentile("l_extendedprice", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) FILTER (WHERE i = ceil(n * 0.95)) AS p95, min(value) FILTER (WHERE i = ceil(n * 0.5)) AS p50, max(n) AS n FROM r GROUP BY event_type""")
def percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: equal values are one counted row, ranked by running counts, so no group is collected."""
    rows = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    ranked = rows.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col("value")))
    return ranked.groupBy("event_type").agg(at(0.95).alias("p95"), at(0.5).alias("p50"), F.max("n").alias("n"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, arg_max(lang, n) AS lang, max(n) AS n FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1) GROUP BY source""")
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language of each source, the first by name among equals."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "lang"))
    return counts.groupBy("source").agg(best.alias("b")).select("source", "b.lang", (-F.col("b.m")).alias("n"))


@query("""
WITH l AS (SELECT vec_id, label, embedding[1:3]::DOUBLE[] AS z FROM embeddings), m AS (SELECT *, list_max(z) AS m FROM l),
p AS (SELECT vec_id, label, list_transform(z, lambda x: x - m - ln(list_sum(list_transform(z, lambda y: exp(y - m))))) AS p, list_position(z, m) - 1 AS a FROM m)
SELECT vec_id, a::INT AS pred, round(p[1], 7) AS p0, round(p[2], 7) AS p1, round(p[3], 7) AS p2 FROM p""")
def log_softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-softmax of the first three dimensions and its argmax."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("z"))
    p = A.log_softmax(F.col("z"))
    return rows.select("vec_id", A.argmax(F.col("z")).alias("pred"), *[F.round(F.get(p, i), 7).alias(f"p{i}") for i in range(3)])


@query("""
WITH z AS (SELECT label, vec_id, embedding[1:4]::DOUBLE[] AS z FROM embeddings), p AS (SELECT label, vec_id, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM z),
m AS (SELECT label, avg(p[1]) AS a, avg(p[2]) AS b, avg(p[3]) AS c, avg(p[4]) AS d FROM p GROUP BY label)
SELECT label, (list_position([a, b, c, d], greatest(a, b, c, d)) - 1)::INT AS pred, round(greatest(a, b, c, d), 7) AS p FROM m""")
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' softmax averaged by class, then argmax."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 4).cast("array<double>").alias("z"))
    p = F.transform(A.log_softmax(F.col("z")), F.exp)
    means = rows.select("label", p.alias("p")).groupBy("label").agg(F.array(*[F.avg(F.get("p", i)) for i in range(4)]).alias("m"))
    return means.select("label", A.argmax(F.col("m")).alias("pred"), F.round(F.array_max("m"), 7).alias("p"))


@query(f"""WITH {_RULE}, t AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality <> rule) AS errors FROM r GROUP BY source)
SELECT source, n, errors, CASE WHEN n < 5 THEN 'pending' WHEN errors * 10 <= n * 2 THEN 'passed' ELSE 'failed' END AS verdict FROM t""")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed, failed or pending by stratum; the limit compares integers."""
    told = ruled(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") != F.col("rule")).alias("errors"))
    return told.withColumn("verdict", F.when(F.col("n") < 5, "pending").when(F.col("errors") * 10 <= F.col("n") * 2, "passed").otherwise("failed"))


@query(f"""WITH {_RULE}, t AS (SELECT source, count(*) FILTER (WHERE quality <> rule) * 10 > count(*) * 2 AS bad FROM r GROUP BY source), e AS (SELECT d.doc_id, d.source FROM documents d JOIN t USING (source) ANTI JOIN labels USING (doc_id) WHERE bad)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('review:' || doc_id))::INT AS position FROM e QUALIFY position <= 20""")
def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of failed strata the first 20 unlabelled rows by hash: a review queue."""
    rows = ruled(spark, sf_dir).groupBy("source").agg((F.count_if(F.col("quality") != F.col("rule")) * 10 > F.count(F.lit(1)) * 2).alias("bad")).where("bad")
    left = table(spark, sf_dir, "documents").select("doc_id", "source").join(rows, "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    order = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("review:"), F.col("doc_id").cast("string")), 256))
    return left.select("source", "doc_id", F.row_number().over(order).alias("position")).where("position <= 20")
