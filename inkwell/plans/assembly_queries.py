"""Queries that put data sets together: joins of several labellers, unions with gates, leakage checks, quotas, coverage, batches and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import selection, splits
from inkwell.plans.catalogue import query
from inkwell.plans.text_queries import LINES, NORMAL, lines
from inkwell.session import scratch_path, table
from inkwell.sources import files

_TWO = """a AS (SELECT doc_id, quality AS q, toxic AS t FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS q, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE toxic END AS t FROM labels WHERE doc_id % 17 <> 0)"""


def labellers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two labellers: the second lacks rows and differs in some."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")  # noqa: E741
    b = l.where("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("q2"), F.when(F.col("doc_id") % 13 != 0, F.col("toxic")).alias("t2"))
    return l.select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t")), b


@query(f"WITH {_TWO} SELECT a.doc_id, b.doc_id IS NULL AS missing, a.q IS DISTINCT FROM b.q OR a.t IS DISTINCT FROM b.t AS differs FROM a LEFT JOIN b USING (doc_id)")
def labeller_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labellers' rows side by side: whether the second is missing or differs anywhere."""
    a, b = labellers(spark, sf_dir)
    told = a.join(b.withColumn("there", F.lit(True)), "doc_id", "left")
    return told.select("doc_id", F.col("there").isNull().alias("missing"), (~(F.col("q").eqNullSafe(F.col("q2")) & F.col("t").eqNullSafe(F.col("t2")))).alias("differs"))


@query(f"""WITH {_TWO}, j AS (SELECT doc_id, a.q AS qa, b.q AS qb, ('0x' || substr(sha256('blind:' || doc_id), 1, 2))::INT % 2 = 1 AS swapped FROM a JOIN b USING (doc_id))
SELECT doc_id, swapped, CASE WHEN qa IS NOT DISTINCT FROM qb THEN 'agreed' WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'adjudicated' END AS outcome,
  CASE WHEN qa IS NOT DISTINCT FROM qb THEN qa WHEN doc_id % 4 = 0 THEN NULL WHEN (doc_id % 4 = 1) = swapped THEN qb ELSE qa END::INT AS final FROM j""")
def blinded_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreed labels stay; where two differ a judge picked X or Y, and a hash bit says which labeller that was."""
    a, b = labellers(spark, sf_dir)
    swapped = F.conv(F.substring(T.seeded_hash("blind", F.col("doc_id")), 1, 2), 16, 10).cast("int") % 2 == 1
    same, k = F.col("q").eqNullSafe(F.col("q2")), F.col("doc_id") % 4
    return a.join(b, "doc_id").withColumn("swapped", swapped).select(
        "doc_id", "swapped", F.when(same, "agreed").when(k == 0, "pending").otherwise("adjudicated").alias("outcome"),
        F.when(same, F.col("q")).when(k == 0, None).when((k == 1) == F.col("swapped"), F.col("q2")).otherwise(F.col("q")).cast("int").alias("final"))


@query("""SELECT d.doc_id, row_number() OVER (ORDER BY sha256('queue:' || d.doc_id)) - 1 AS position, l.quality, COALESCE(e.label, -1) AS annotator, COALESCE(b.item_id, -1) AS item
FROM documents d JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue joined with labels, annotators and notes, in queue order; what is missing has a default."""
    from inkwell.operators.ranks import number_rows

    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    d = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").join(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("item")), "doc_id", "left")
    return number_rows(d, T.seeded_hash("queue", F.col("doc_id")), name="position").select(
        "doc_id", "position", "quality", F.coalesce("label", F.lit(-1)).alias("annotator"), F.coalesce("item", F.lit(-1)).alias("item"))


@query("""WITH s AS (SELECT doc_id, lang, 'labelled' AS arm FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, lang, 'silver' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, 'extra' FROM documents WHERE doc_id % 5 = 0),
h AS (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)
SELECT arm, count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM h)) AS held_out, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM h)) AS kept FROM s GROUP BY arm""")
def training_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping unions as tagged arms, gated by the held-out ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    one = lambda rows, arm: rows.withColumn("arm", F.lit(arm))
    s = one(d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "labelled").unionByName(one(d.where("doc_id % 3 = 0"), "silver")).unionByName(one(d.where("doc_id % 5 = 0"), "extra"))
    held = F.col("doc_id") % 7 == 0
    return s.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.count_if(held).alias("held_out"), F.count_if(~held).alias("kept"))


@query("""WITH u AS (SELECT doc_id AS id, source AS set_name FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark UNION ALL SELECT conv_id, 'conversations' FROM conversations)
SELECT set_name, count(*) AS n, count(*) - count(DISTINCT id) AS n_repeats FROM u GROUP BY set_name""")
def union_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of several tables and how often a composite key repeats in each."""
    u = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("set_name"))
    u = u.union(table(spark, sf_dir, "benchmark").select("item_id", F.lit("benchmark"))).union(table(spark, sf_dir, "conversations").select("conv_id", F.lit("conversations")))
    return u.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("n_repeats"))


_BAG = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w NOT IN ('cho', 'minh', 'tao', 'toi', 'lai', 'roi', 'nha', 'ok', 'da', 'dc', 'duoc') AND w <> '')), ' ')"


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line_no, source, {NORMAL.format('line')} AS norm FROM lines WHERE line <> ''), k AS (SELECT *, {_BAG.format('norm')} AS bag FROM c),
e AS (SELECT norm, {_BAG.format('norm')} AS bag FROM (SELECT {NORMAL.format("unnest(string_split(text, chr(10)))")} AS norm FROM benchmark)),
n AS (SELECT norm, count(*) AS copies, count(DISTINCT source) AS groups FROM k GROUP BY norm)
SELECT doc_id, line_no::INT AS line_no, list_filter([CASE WHEN k.norm <> '' AND k.norm IN (SELECT norm FROM e) THEN 'eval_norm_match' END, CASE WHEN bag <> '' AND bag IN (SELECT bag FROM e WHERE bag <> '') THEN 'eval_bag_match' END, CASE WHEN copies > 1 THEN 'batch_duplicate' END], lambda x: x IS NOT NULL) AS reject,
  CASE WHEN groups > 3 THEN ['template_collapse'] ELSE []::VARCHAR[] END AS warn FROM k JOIN n USING (norm)""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each line is rejected or warned of: equal to an evaluation line by normal form or bag of words, repeated, or a template that several groups share."""
    c = lines(spark, sf_dir).where("line <> ''").select("doc_id", "line_no", "source", T.normalize(F.col("line")).alias("norm"))
    c = c.withColumn("bag", T.bag_key(F.col("norm")))
    e = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).select(T.normalize(F.col("line")).alias("norm"))
    e = e.withColumn("bag", T.bag_key(F.col("norm")))
    known = lambda key, name: e.where(F.col(key) != "").select(key).distinct().withColumn(name, F.lit(True))
    part = c.groupBy("norm", "source").agg(F.count(F.lit(1)).alias("n"))  # a line that a third of all rows hold is one row for each source from here on
    n = part.groupBy("norm").agg(F.sum("n").alias("copies"), F.count("source").alias("groups"))
    told = c.join(n, "norm").join(known("norm", "by_norm"), "norm", "left").join(known("bag", "by_bag"), "bag", "left")
    return told.select(
        "doc_id", "line_no", F.array_compact(F.array(F.when(F.col("by_norm"), "eval_norm_match"), F.when(F.col("by_bag"), "eval_bag_match"), F.when(F.col("copies") > 1, "batch_duplicate"))).alias("reject"),
        F.when(F.col("groups") > 3, F.array(F.lit("template_collapse"))).otherwise(F.array().cast("array<string>")).alias("warn"))


@query(f"""WITH {_TWO} SELECT CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 3000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n, round(avg((a.q IS NOT DISTINCT FROM b.q)::INT), 9) AS quality_agrees, round(avg((a.t IS NOT DISTINCT FROM b.t)::INT), 9) AS toxic_agrees
FROM a JOIN b USING (doc_id) JOIN documents USING (doc_id) GROUP BY bucket""")
def agreement_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two labellers agree, by length of the text."""
    a, b = labellers(spark, sf_dir)
    n = F.length("text")
    told = a.join(b, "doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return told.groupBy(F.when(n < 500, "short").when(n < 3000, "middle").otherwise("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("q").eqNullSafe(F.col("q2")).cast("int")), 9).alias("quality_agrees"), F.round(F.avg(F.col("t").eqNullSafe(F.col("t2")).cast("int")), 9).alias("toxic_agrees"))


_RULES = (("short", "n < 300", 20), ("english", "lang = 'en'", 25), ("digits", "has_digit", 15), ("all", "n >= 0", 60))


def _rule_sql() -> str:
    parts = ["p AS (SELECT doc_id, lang, length(text) AS n, regexp_matches(text, '\\d') AS has_digit, sha256('rules:' || doc_id) AS h, regexp_replace(lower(substr(text, 1, 40)), '\\d', '#', 'g') AS template FROM documents WHERE text IS NOT NULL)",
             "c0 AS (SELECT *, '' AS rule FROM p LIMIT 0)"]
    for k, (name, test, quota) in enumerate(_RULES):
        parts.append(f"""c{k + 1} AS (SELECT * FROM c{k} UNION ALL SELECT *, '{name}' FROM (SELECT * FROM (SELECT * FROM p WHERE {test} AND doc_id NOT IN (SELECT doc_id FROM c{k}) AND template NOT IN (SELECT template FROM c{k}) QUALIFY row_number() OVER (PARTITION BY template ORDER BY h, doc_id) = 1)
  QUALIFY row_number() OVER (ORDER BY h, doc_id) <= {quota} - (SELECT count(*) FROM c{k} WHERE {test})))""")
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, rule FROM c{len(_RULES)}"


@query(_rule_sql())
def rule_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with quotas, in turn, over rows and templates that are chosen once."""
    pool = table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", "lang", F.length("text").alias("n"), F.col("text").rlike(r"\d").alias("has_digit"), T.seeded_hash("rules", F.col("doc_id")).alias("h"), F.regexp_replace(F.lower(F.substring("text", 1, 40)), r"\d", "#").alias("template"))
    chosen, _ = selection.by_rules(pool, [(n, F.expr(t), q) for n, t, q in _RULES], ["h", "doc_id"], "doc_id", "template")
    return chosen.select("doc_id", "rule")


@query("""WITH r AS (SELECT doc_id, lang, length(text) AS n, (row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1) // 64 AS chunk FROM documents), d AS (SELECT chunk FROM r GROUP BY chunk HAVING bool_or(doc_id % 50 = 0))
SELECT chunk, count(*) AS n_rows, min(n) AS least, max(n) AS most FROM r WHERE chunk NOT IN (SELECT chunk FROM d) GROUP BY chunk""")
def open_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 in order of length; those that are done already are left out, so a repeated run resumes."""
    r = selection.micro_batches(table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")), F.struct((-F.col("n")).alias("a"), "doc_id"), 64)
    done = r.where("doc_id % 50 = 0").select("chunk").distinct()
    return r.join(done, "chunk", "left_anti").groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"id": ' || doc_id || ', "lang": "' || lang || '"},' WHEN 1 THEN '{"id": ' || doc_id || ', "lang": "' || lang || '"}' WHEN 2 THEN '{"id": ' || doc_id ELSE 'text ' || doc_id END AS line FROM documents)
SELECT lang, count(*) AS n, SUM(doc_id)::BIGINT AS ids FROM (SELECT doc_id, regexp_extract(line, '"lang": "([a-z]*)"', 1) AS lang FROM l WHERE doc_id % 4 < 2) GROUP BY lang""")
def permissive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with trailing commas, cut-off objects and plain text: what can be read is."""
    i, lang = F.col("doc_id"), F.col("lang")
    whole = F.concat(F.lit('{"id": '), i, F.lit(', "lang": "'), lang, F.lit('"}'))
    line = F.when(i % 4 == 0, F.concat(whole, F.lit(","))).when(i % 4 == 1, whole).when(i % 4 == 2, F.concat(F.lit('{"id": '), i)).otherwise(F.concat(F.lit("text "), i))
    rows = files.permissive_jsonl(table(spark, sf_dir, "documents").select(line.alias("line")), "id long, lang string")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("""SELECT count(*) AS n, round(SUM(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 3) AS total FROM embeddings""")
def cached_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written with a manifest, read back and checked against it."""
    path = scratch_path(spark, "cache")
    e = table(spark, sf_dir, "embeddings")
    back = files.load_cache(spark, path, files.write_cache(e, path, "vec_id"), "vec_id")
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)), 3).alias("total"))


@query("""WITH s AS (SELECT doc_id AS id, lang AS v, 0 AS priority FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 'xx' ELSE lang END, 1 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, 2 FROM documents)
SELECT id, arg_min(v, priority) AS v, min(priority)::INT AS priority, count(DISTINCT COALESCE(v, '')) > 1 AS differs FROM s GROUP BY id""")
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id from the first of three sources that has it, and whether the others differ."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("v"))
    second = d.where("id % 2 = 0").withColumn("v", F.when(F.col("id") % 12 == 0, "xx").otherwise(F.col("v")))
    return selection.first_by_priority([d.where("id % 3 = 0"), second, d], "id").select("id", "v", "priority", "differs")


@query()
def covered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and lengths as leakage groups of documents, dealt to splits by language, then moved so that held-out splits cover every language."""
    d = table(spark, sf_dir, "documents").select((F.xxhash64("source", F.length("text")) % 100_000).alias("group"), "lang")
    told = splits.leakage_safe_split(d, "group", "lang", "cover")
    return selection.ensure_coverage(told.select("group", "n", "split"), d.withColumnRenamed("lang", "kind"))


@query("""WITH t AS (SELECT event_type, event_id, ts, user_id % 40 AS value FROM events), f AS (SELECT event_type, value, min(ts) AS first FROM t GROUP BY ALL)
SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY first DESC, value)::INT AS age FROM f QUALIFY age <= 20""")
def bounded_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry of twenty values holds at the end where the oldest makes room: the newest by first arrival."""
    f = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 40).alias("value")).agg(F.min("ts").alias("first"))
    age = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("first").desc(), "value"))
    return f.withColumn("age", age).where("age <= 20").select("event_type", "value", "age")
