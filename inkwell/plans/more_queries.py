"""Queries over splits, review plans, vocabularies, spans and criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import decode as D
from inkwell.functions import spans as S
from inkwell.operators import splits
from inkwell.operators.ranks import number_rows
from inkwell.plans.catalogue import query
from inkwell.plans.metric_queries import _RULE, ruled
from inkwell.session import table

MOVES = [[0.5, 0.0, -9.0], [0.0, -1.0, 0.5], [0.0, 0.0, 0.25]]


@query("""
WITH RECURSIVE c AS (SELECT o_custkey, o_orderpriority AS s, count(*) AS k FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, SUM(k)::BIGINT AS n, arg_min(s, (-k, s)) AS stratum FROM c GROUP BY o_custkey),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, sha256('deal:' || o_custkey)) AS i, SUM(n) OVER (PARTITION BY stratum) AS total FROM g),
d(stratum, i, a, b, c, o_custkey, n, split) AS (
  SELECT DISTINCT stratum, 0::BIGINT, (70 * total)::BIGINT, (15 * total)::BIGINT, (15 * total)::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::VARCHAR FROM o UNION ALL
  SELECT stratum, i, a - CASE WHEN s = 'train' THEN 100 * n ELSE 0 END, b - CASE WHEN s = 'validation' THEN 100 * n ELSE 0 END, c - CASE WHEN s = 'test' THEN 100 * n ELSE 0 END, o_custkey, n, s FROM (
    SELECT o.stratum, o.i, a, b, c, o.o_custkey, o.n, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END AS s FROM d JOIN o ON o.stratum = d.stratum AND o.i = d.i + 1))
SELECT o_custkey, n, stratum, split FROM d WHERE i > 0""")
def leakage_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as groups, dealt to splits within their main order priority."""
    return splits.leakage_safe_split(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", "deal")


@query("""
WITH d AS (SELECT doc_id, length(text) AS n, contains(text, '@') AS must, regexp_matches(text, '[#*$%&]{3}') AS hard FROM documents), m AS (SELECT quantile_cont(n, 0.5) AS median FROM d)
SELECT doc_id, CASE WHEN must THEN 'must' WHEN hard AND n > median THEN 'hard' WHEN ('0x' || substr(sha256('plan:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.1 THEN 'audit' ELSE 'auto' END AS action FROM d, m""")
def plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to review: all risky rows, hard ones beyond the median length, and a seeded audit."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").alias("n"), F.contains("text", F.lit("@")).alias("must"), F.col("text").rlike(r"[#*$%&]{3}").alias("hard"))
    return splits.review_plan(rows, "doc_id", "must", "hard", "plan")


@query(r"""
WITH d AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{4,}') AS word, length(text) // 2 AS claimed FROM documents),
h AS (SELECT doc_id, word, claimed, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(word)) = word)) AS pos FROM d WHERE word <> '')
SELECT doc_id, word, arg_min(pos, (abs(pos - claimed), pos))::INT AS start, count(*) AS n_hits FROM h GROUP BY doc_id, word""")
def offset_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occurrence of a span's text nearest to its claimed start, overlapping occurrences included: a lookahead finds
    them in one pass."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("word"), F.expr("length(text) div 2").alias("claimed")).where("word <> ''")
    places = S.occurrences(F.col("text"), F.col("word"))
    best = F.array_min(F.transform("hits", lambda at: F.struct(F.abs(at - F.col("claimed")).alias("gap"), at.alias("at"))))
    return d.select("doc_id", "word", "claimed", places.alias("hits")).select("doc_id", "word", best["at"].cast("int").alias("start"), F.size("hits").cast("long").alias("n_hits"))


@query(r"""
WITH s AS (SELECT doc_id, text, length(text) AS n, length(text) // 4 AS ts, length(text) // 2 AS te, length(text) // 3 AS vs, 2 * length(text) // 3 AS ve FROM documents),
c AS (SELECT *, list_sort(list_distinct([0, n, ts, te, vs, ve])) AS cuts FROM s), p AS (SELECT *, unnest(range(1, len(cuts))) AS i FROM c)
SELECT doc_id, i::INT AS i, cuts[i]::INT AS s, cuts[i + 1]::INT AS e, CASE WHEN ts <= cuts[i] AND cuts[i + 1] <= te THEN 'target' WHEN vs <= cuts[i] AND cuts[i + 1] <= ve THEN 'value' END AS role,
  ts <= cuts[i] AND cuts[i + 1] <= te AND vs <= cuts[i] AND cuts[i + 1] <= ve AS overlap FROM p""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at two spans into segments with roles."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).selectExpr(
        "doc_id", "n", "int(n div 4) ts", "int(n div 2) te", "int(n div 3) vs", "int(2 * n div 3) ve")
    cuts = s.withColumn("cuts", F.array_sort(F.array_distinct(F.array(F.lit(0), "n", "ts", "te", "vs", "ve"))))
    rows = cuts.select("*", F.posexplode("cuts").alias("p", "s")).withColumn("e", F.get("cuts", F.col("p") + 1)).where("e is not null")
    target, value = F.expr("ts <= s and e <= te"), F.expr("vs <= s and e <= ve")
    return rows.select("doc_id", (F.col("p") + 1).alias("i"), "s", "e", F.when(target, "target").when(value, "value").alias("role"), (target & value).alias("overlap"))


@query(r"""
WITH v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), n AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM v),
t AS (SELECT item_id, unnest(range(1, len(l) + 1)) AS p, l FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM benchmark))
SELECT item_id, p::INT AS p, id FROM t JOIN n ON w = l[p]""")
def remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as contiguous ids of the kept vocabulary, in order of name."""
    tokens = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("p", "w")).withColumn("p", F.col("p") + 1)
    ids = number_rows(tokens.select("w").distinct(), "w", name="id")
    return tokens.join(ids, "w").select("item_id", "p", "id")


@query(r"""
WITH v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), m AS (SELECT w, unnest(range(1, length(w))) AS i FROM v),
p AS (SELECT w, min(i) AS rank FROM m WHERE substr(w, 1, i) IN (SELECT w FROM v) AND substr(w, i + 1) IN (SELECT w FROM v) GROUP BY w)
SELECT v.w, p.w IS NULL AS orphan, p.rank::INT AS merge_rank FROM v LEFT JOIN p USING (w)""")
def vocab_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary entries that no pair of entries makes, and the first cut of the others."""
    v = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).select(F.lower("w").alias("w")).distinct()
    cuts = v.where(F.length("w") > 1).select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    cuts = cuts.select("w", "i", F.substring("w", F.lit(1), F.col("i")).alias("a"), F.substring("w", F.col("i") + 1, F.length("w")).alias("b"))
    made = cuts.join(v.select(F.col("w").alias("a")), "a", "left_semi").join(v.select(F.col("w").alias("b")), "b", "left_semi").groupBy("w").agg(F.min("i").alias("merge_rank"))
    return v.join(made, "w", "left").select("w", F.col("merge_rank").isNull().alias("orphan"), "merge_rank")


@query("""SELECT chr(c::INT) AS missing FROM range(33, 127) t(c) WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE contains(text, chr(c::INT)))""")
def missing_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable characters that no item holds."""
    present = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("missing")).distinct()
    return spark.range(33, 127).select(F.char("id").alias("missing")).join(present, "missing", "left_anti")


@query(f"""WITH {_RULE}, t AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = rule) AS a, count(*) FILTER (WHERE toxic = 0) AS b FROM r GROUP BY lang)
SELECT lang, n, a, b, b - a AS dropped, (a - b) * 100 <= 5 * n AS pass FROM t""")
def regression_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one system loses at most 5% against another; integers only, so no rounding decides."""
    told = ruled(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == F.col("rule")).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    return told.withColumn("dropped", F.col("b") - F.col("a")).withColumn("pass", (F.col("a") - F.col("b")) * 100 <= F.col("n") * 5)


@query(f"""WITH {_RULE}, m AS (SELECT count(*) AS n, avg((quality = rule)::INT) AS acc, avg(toxic) AS tox FROM r)
SELECT name, round(value, 9) AS value, threshold::DOUBLE AS threshold, ok AS pass FROM (SELECT 'rows' AS name, n::DOUBLE AS value, 50 AS threshold, n >= 50 AS ok FROM m UNION ALL SELECT 'accuracy', acc, 0.6, acc >= 0.6 FROM m UNION ALL SELECT 'toxic_rate', tox, 0.2, tox <= 0.2 FROM m)""")
def quality_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named criteria with thresholds over one aggregate."""
    m = ruled(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("quality") == F.col("rule")).cast("int")).alias("acc"), F.avg("toxic").alias("tox"))
    rows = [("rows", F.col("n").cast("double"), 50.0, F.col("n") >= 50), ("accuracy", F.col("acc"), 0.6, F.col("acc") >= 0.6), ("toxic_rate", F.col("tox"), 0.2, F.col("tox") <= 0.2)]
    told = F.array(*[F.struct(F.lit(k).alias("name"), F.round(v, 9).alias("value"), F.lit(t).alias("threshold"), ok.alias("pass")) for k, v, t, ok in rows])
    return m.select(F.inline(told))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS i FROM c)
SELECT source, string_agg(lang || ':' || n, ', ' ORDER BY i) AS summary FROM r GROUP BY source""")
def intent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string summary of each source's languages."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang")))
    return counts.groupBy("source").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["lang"], F.lit(":"), (-x["m"]).cast("string"))), ", ").alias("summary"))


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS z FROM embeddings) SELECT label, count(*) AS n, round(avg(list_sum(z)), 6) AS mean, round(max(list_max(z)), 6) AS most,
  round(avg(sqrt(list_sum(list_transform(z, lambda x: x * x)))), 6) AS norm FROM e GROUP BY label""")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, maxima and norms of vectors by label."""
    from inkwell.functions import arrays as A

    z = F.transform("embedding", lambda x: F.round(x.cast("double"), 3))
    return table(spark, sf_dir, "embeddings").select("label", z.alias("z")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(A.total(F.col("z"))), 6).alias("mean"), F.round(F.max(F.array_max("z")), 6).alias("most"), F.round(F.avg(F.sqrt(A.dot(F.col("z"), F.col("z")))), 6).alias("norm"))


def _way(j: int) -> str:
    return "[" + ", ".join(f"{{'v': tot[{i + 1}] + {MOVES[i][j]}, 'i': {-i}}}" for i in range(3)) + "]"


@query(f"""
WITH RECURSIVE l AS (SELECT vec_id, embedding, unnest(range(1, len(embedding) // 3 + 1)) AS p FROM embeddings), r AS (SELECT vec_id, p, embedding[3 * p - 2]::DOUBLE AS a, embedding[3 * p - 1]::DOUBLE AS b, embedding[3 * p]::DOUBLE AS c FROM l),
v(vec_id, p, tot, paths) AS (SELECT vec_id, p, [a, b, c], [[0], [1], [2]] FROM r WHERE p = 1 UNION ALL
  SELECT vec_id, p, [w[1].v + a, w[2].v + b, w[3].v + c], [list_append(paths[1 - w[1].i], 0), list_append(paths[1 - w[2].i], 1), list_append(paths[1 - w[3].i], 2)]
  FROM (SELECT r.vec_id, r.p, a, b, c, paths, [list_max({_way(0)}), list_max({_way(1)}), list_max({_way(2)})] AS w FROM v JOIN r ON r.vec_id = v.vec_id AND r.p = v.p + 1))
SELECT vec_id, paths[1 - list_max([{{'v': tot[1], 'i': 0}}, {{'v': tot[2], 'i': -1}}, {{'v': tot[3], 'i': -2}}]).i]::INT[] AS tags FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) = 1""")
def viterbi_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tag path of each vector read as steps of three scores."""
    flat = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", D.viterbi(D.rows_of(flat), MOVES).alias("tags"))


_SOFT = """s AS (SELECT vec_id, label, list_transform([0, 1, 2], lambda k: list_sum(list_transform(range(1, len(embedding) // 6 + 1), lambda i: embedding[6 * i - 5 + k]::DOUBLE))) AS a,
  list_transform([0, 1, 2], lambda k: list_sum(list_transform(range(1, len(embedding) // 6 + 1), lambda i: embedding[6 * i - 2 + k]::DOUBLE))) AS b FROM embeddings),
p AS (SELECT vec_id, label, list_transform(a, lambda x: exp(x - list_max(a)) / list_sum(list_transform(a, lambda y: exp(y - list_max(a))))) AS p,
  list_transform(b, lambda x: exp(x - list_max(b)) / list_sum(list_transform(b, lambda y: exp(y - list_max(b))))) AS q FROM s)"""


def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distributions over three types from each vector: every sixth number adds to one of the six logits."""
    from inkwell.functions import arrays as A

    z = F.col("embedding").cast("array<double>")
    steps = F.sequence(F.lit(0), F.floor(F.size("embedding") / 6).cast("int") - 1)
    logit = lambda at: A.total(F.transform(steps, lambda i: F.get(z, i * 6 + at)))
    part = lambda at: F.transform(A.log_softmax(F.array(*[logit(at - 1 + k) for k in range(3)])), F.exp)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", part(1).alias("p"), part(4).alias("q"))


@query(f"""WITH {_SOFT} SELECT vec_id, round(p[1] * ln(p[1] / q[1]) + p[2] * ln(p[2] / q[2]) + p[3] * ln(p[3] / q[3]), 7) AS kl,
  round(-(p[1] * ln(q[1]) + p[2] * ln(q[2]) + p[3] * ln(q[3])), 7) AS cross_entropy FROM p""")
def soft_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence and cross entropy between a vector's two distributions."""
    from inkwell.functions import arrays as A

    entropy = -A.dot(F.col("p"), F.transform("q", lambda x: F.log(x)))
    return soft(spark, sf_dir).select("vec_id", F.round(A.kl_divergence(F.col("p"), F.col("q")), 7).alias("kl"), F.round(entropy, 7).alias("cross_entropy"))


@query(f"""WITH {_SOFT}, r AS (SELECT vec_id, [round(p[1], 1), round(p[2], 1), round(p[3], 1)] AS p FROM p)
SELECT vec_id, ['expense', 'income', 'transfer'][list_position(p, list_max(p))] AS type, list_filter([CASE WHEN abs(list_sum(p) - 1) > 0.01 THEN 'sum' END, CASE WHEN list_min(p) = 0 THEN 'zero' END], lambda x: x IS NOT NULL) AS violations FROM r""")
def soft_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded distributions as maps: the contract's broken rules, and the largest type in fixed order."""
    from inkwell.functions import arrays as A

    types = F.array(*map(F.lit, ("expense", "income", "transfer")))
    rows = soft(spark, sf_dir).select("vec_id", F.map_from_arrays(types, F.transform("p", lambda x: F.round(x, 1))).alias("m"))
    values = F.map_values("m")
    return rows.select(
        "vec_id", F.element_at(types, A.argmax(values) + 1).alias("type"),
        F.array_compact(F.array(F.when(F.abs(A.total(values) - 1) > 0.01, "sum"), F.when(F.array_min(values) == 0, "zero"))).alias("violations"))


@query("""
WITH r AS (SELECT o_orderpriority, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS i FROM orders)
SELECT o_orderpriority, list(o_orderkey ORDER BY i) FILTER (WHERE i <= 3) AS latest, count(*) AS n FROM r GROUP BY o_orderpriority""")
def latest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest orders of each priority and their count; top three by task first."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    local = rows.withColumn("p", F.spark_partition_id()).withColumn("r", F.row_number().over(by("o_orderpriority", "p"))).where("r <= 3")
    top = local.withColumn("r", F.row_number().over(by("o_orderpriority"))).where("r <= 3")
    lists = top.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("r", "o_orderkey"))).alias("l"))
    counts = rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(lists, "o_orderpriority").select("o_orderpriority", F.transform("l", lambda x: x["o_orderkey"]).alias("latest"), "n")


@query("""
SELECT doc_id, CASE WHEN text IN (SELECT text FROM benchmark) THEN 'test_text' WHEN source LIKE 'src1%' THEN 'held_source' WHEN COALESCE(toxic, 0) = 1 THEN 'toxic' END AS reason FROM documents LEFT JOIN labels USING (doc_id)""")
def forbidden_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row may not be trained on, the first reason that holds."""
    known = table(spark, sf_dir, "benchmark").select("text", F.lit(True).alias("known")).distinct()
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = table(spark, sf_dir, "documents").join(known, "text", "left").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("known"), "test_text").when(F.col("source").startswith("src1"), "held_source").when(F.col("toxic") == 1, "toxic").alias("reason"))


@query("""
WITH a AS (SELECT doc_id, unnest(list_filter(['all', CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN COALESCE(toxic, 0) = 0 THEN 'safe' END], lambda x: x IS NOT NULL)) AS arm, length(text) AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT arm, count(*) AS n_rows, SUM(n)::BIGINT AS n_chars FROM a GROUP BY arm""")
def arms_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping training arms as one tagged union."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    arms = F.array_compact(F.array(F.lit("all"), F.when(F.col("lang") == "en", "english"), F.when(F.col("quality") == 1, "good"), F.when(F.coalesce("toxic", F.lit(0)) == 0, "safe")))
    return rows.select(F.explode(arms).alias("arm"), "n").groupBy("arm").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_chars"))


@query(r"""
WITH n AS (SELECT lang, unnest(regexp_extract_all(text, '\d[\d.,]*')) AS x FROM documents), c AS (SELECT lang, CASE WHEN regexp_matches(x, '^\d+$') THEN 'plain' WHEN regexp_matches(x, '^\d{1,3}([.,]\d{3})+$') THEN 'grouped' WHEN regexp_matches(x, '^\d+[.,]\d+$') THEN 'decimal' ELSE 'other' END AS kind, length(x) AS l FROM n)
SELECT lang, kind, count(*) AS n, max(l)::INT AS longest FROM c GROUP BY ALL""")
def number_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written numbers by language and form."""
    x = F.col("x")
    kind = F.when(x.rlike(r"^\d+$"), "plain").when(x.rlike(r"^\d{1,3}([.,]\d{3})+$"), "grouped").when(x.rlike(r"^\d+[.,]\d+$"), "decimal").otherwise("other")
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\d[\d.,]*"), 0)).alias("x"))
    return rows.groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("x")).alias("longest"))


@query(r"""
WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w)::INT AS rank FROM c QUALIFY rank <= 30""")
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most used words of each language."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w"))
    counts = words.groupBy("lang", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    local = Window.partitionBy("lang", "p").orderBy(F.col("n").desc(), "w")
    near = counts.withColumn("p", F.spark_partition_id()).withColumn("rank", F.row_number().over(local)).where("rank <= 30").drop("p")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "w"))).where("rank <= 30")


@query("""
WITH c AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY sha256('fix:' || p_partkey)) AS k FROM part)
SELECT p_partkey, p_size, row_number() OVER (ORDER BY k > 1, sha256('fix:' || p_partkey))::INT AS position FROM c QUALIFY position <= 60""")
def repair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty rows, a first of every size before any second, each in hash order."""
    h = F.sha2(F.concat(F.lit("fix:"), F.col("p_partkey").cast("string")), 256)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", h.alias("h"))
    first = rows.groupBy("p_size").agg(F.min("h").alias("least"))
    told = rows.join(first, "p_size").withColumn("later", F.col("h") > F.col("least")).orderBy("later", "h").limit(60)
    return told.select("p_partkey", "p_size", F.row_number().over(Window.orderBy("later", "h")).alias("position"))


@query("""
WITH s(seed) AS (SELECT DISTINCT l_linenumber FROM lineitem), f(flag) AS (SELECT DISTINCT l_returnflag FROM lineitem), c AS (SELECT l_linenumber AS seed, l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL)
SELECT seed, flag, COALESCE(n, 0) AS n FROM s CROSS JOIN f LEFT JOIN c USING (seed, flag)""")
def zero_filled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over every combination of two small dimensions."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("flag"), "l_quantity")
    hit = F.count_if(F.col("l_quantity") > 45).alias("n")
    return rows.groupBy("seed").pivot("flag", ["A", "N", "R"]).agg(hit).na.fill(0).unpivot("seed", ["A", "N", "R"], "flag", "n")
