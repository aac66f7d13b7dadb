"""Queries over records of a notes store, scans with a contract, losses, and named checks of a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import arrays as A
from inkwell.operators import labelling
from inkwell.plans.catalogue import query
from inkwell.session import table
from inkwell.streaming.registry import snapshot

_NOTE = """'{"id": "' || CASE WHEN event_id % 11 = 0 THEN '' ELSE 'n' || event_id END || '", "text": ' || CASE WHEN event_id % 13 = 0 THEN '7' ELSE '"t"' END || ', "createdAt": ' || event_id || ', "amount": ' || CASE WHEN event_id % 5 = 0 THEN 'null' WHEN event_id % 7 = 0 THEN '"many"' ELSE '1.5' END
  || CASE WHEN event_id % 3 = 0 THEN ', "currency": "USD"' WHEN event_id % 17 = 0 THEN ', "currency": "XYZ"' ELSE '' END || '}'"""


@query("""SELECT event_id, event_id % 11 <> 0 AND event_id % 13 <> 0 AND (event_id % 5 = 0 OR event_id % 7 <> 0) AND (event_id % 3 = 0 OR event_id % 17 <> 0) AS valid FROM events""")
def note_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored notes, as JSON, are records of the store: types of fields by a variant, optional and nullable fields included."""
    v = F.try_parse_json(F.expr(_NOTE))
    e = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    text = lambda path: F.try_variant_get("v", path, "string")
    is_text = lambda path: kind(path).eqNullSafe("STRING")
    number = lambda path: kind(path).rlike("^(?:BIGINT|DECIMAL|DOUBLE)")
    amount = number("$.amount") | kind("$.amount").eqNullSafe("VOID")
    ok = is_text("$.id") & (text("$.id") != "") & is_text("$.text") & number("$.createdAt") & amount & (text("$.currency").isNull() | text("$.currency").isin("USD", "VND"))
    return e.select("event_id", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("""SELECT doc_id, list_filter([CASE WHEN lang IS NULL THEN 'missing type' END, CASE WHEN lang NOT IN ('de', 'en', 'fr') THEN 'unknown type' END, CASE WHEN source LIKE 'src1%' THEN 'probe source' END, CASE WHEN text IS NULL OR text = '' THEN 'missing text' END], lambda x: x IS NOT NULL) AS problems
FROM documents WHERE lang IS NULL OR lang NOT IN ('de', 'en', 'fr') OR source LIKE 'src1%' OR text IS NULL OR text = ''""")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a training scan refuses, with the reasons."""
    problems = F.array_compact(F.array(
        F.when(F.col("lang").isNull(), "missing type"), F.when(~F.col("lang").isin("de", "en", "fr"), "unknown type"), F.when(F.col("source").startswith("src1"), "probe source"),
        F.when(F.col("text").isNull() | (F.col("text") == ""), "missing text")))
    return table(spark, sf_dir, "documents").select("doc_id", problems.alias("problems")).where(F.size("problems") > 0)


_P = "list_transform({0}, lambda x: exp(x - list_max({0})) / list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"


@query(f"""WITH z AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e[1:4] AS a, list_transform(e[5:8], lambda x: x / 2) AS t, list_transform(e[1:4], lambda x: x / 2) AS h, label % 4 + 1 AS y FROM z),
p AS (SELECT vec_id, y, {_P.format('a')} AS p, {_P.format('t')} AS q, {_P.format('h')} AS r FROM s)
SELECT vec_id, round(-ln(p[y]), 6) AS hard, round(4 * (q[1] * ln(q[1] / r[1]) + q[2] * ln(q[2] / r[2]) + q[3] * ln(q[3] / r[3]) + q[4] * ln(q[4] / r[4])), 6) AS soft,
  round(0.3 * -ln(p[y]) + 0.7 * 4 * (q[1] * ln(q[1] / r[1]) + q[2] * ln(q[2] / r[2]) + q[3] * ln(q[3] / r[3]) + q[4] * ln(q[4] / r[4])), 6) AS loss FROM p""")
def distillation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted sum of a hard and a softened loss, at temperature 2, of every pair of logit rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4 + 1).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    half = lambda at: F.transform(A.log_softmax(F.transform(F.slice("z", at, 4), lambda x: x / 2)), F.exp)
    told = e.select("vec_id", (-F.element_at(A.log_softmax(F.slice("z", 1, 4)), F.col("y"))).alias("hard"), (4 * A.kl_divergence(half(5), half(1))).alias("soft"))
    return told.select("vec_id", F.round("hard", 6).alias("hard"), F.round("soft", 6).alias("soft"), F.round(F.col("hard") * 0.3 + F.col("soft") * 0.7, 6).alias("loss"))


@query("""WITH d AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE text IS NULL) AS empty FROM documents), l AS (SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)), b AS (SELECT count(*) AS n FROM benchmark)
SELECT name, ok, detail FROM (SELECT unnest(['documents', 'unique ids', 'texts', 'labels refer to documents', 'benchmark']) AS name, unnest([d.n > 0, d.n = d.ids, d.empty = 0, l.n = 0, b.n >= 40]) AS ok, unnest([d.n::VARCHAR, d.ids::VARCHAR, d.empty::VARCHAR, l.n::VARCHAR, b.n::VARCHAR]) AS detail FROM d, l, b)""")
def release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks of a release with their details: one aggregate for each table."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("text").isNull()).alias("empty"))
    lost = labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("items"))
    told = one.crossJoin(lost).crossJoin(items)  # one row each
    checks = [("documents", F.col("n") > 0, "n"), ("unique ids", F.col("n") == F.col("ids"), "ids"), ("texts", F.col("empty") == 0, "empty"), ("labels refer to documents", F.col("lost") == 0, "lost"), ("benchmark", F.col("items") >= 40, "items")]
    return told.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), ok.alias("ok"), F.col(c).cast("string").alias("detail")) for k, ok, c in checks])))


@query("""SELECT event_type, count(*) AS n, round(SUM(COALESCE(value, 0)), 4) AS total, max(ts) AS last FROM events GROUP BY event_type""")
def stack_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that a stream keeps up, over the table."""
    return snapshot(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT item_id, CASE WHEN item_id % 6 <> 0 THEN 'label ' || length(text) END AS label, CASE WHEN item_id % 6 = 0 THEN 'ValueError: no answer' END AS error FROM benchmark""")
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a function that fails for some rows; failures are rows too."""

    def answer(text: str) -> str:
        number, _, rest = text.partition("|")
        if int(number) % 6 == 0:
            raise ValueError("no answer")
        return f"label {len(rest)}"

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws("|", "item_id", "text").alias("text"))
    return labelling.label_rows(rows, answer, "item_id", pause=0.0).drop("attempts")
