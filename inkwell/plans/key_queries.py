"""Queries over keys, variants, strata and templates of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import keys as K
from inkwell.functions import text as T
from inkwell.plans.catalogue import query
from inkwell.plans.text_queries import NORMAL
from inkwell.session import table

_HEAD = "h AS (SELECT doc_id, substr(text, 1, 200) AS x, 2 + doc_id % 9 AS s, 11 + doc_id % 13 AS e FROM documents WHERE text IS NOT NULL)"


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a span: the heads of documents, which are as long as notes are."""
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", F.substring("text", 1, 200).alias("x"), (2 + F.col("doc_id") % 9).cast("int").alias("s"), (11 + F.col("doc_id") % 13).cast("int").alias("e"))


_MASKED = "substr(x, 1, s) || '{0}' || substr(x, e + 1)"


@query(rf"""WITH {_HEAD}, m AS (SELECT doc_id, x, {_MASKED.format(' § ')} AS t, regexp_replace({_MASKED.format(' x ')}, '(\s)\p{{Lu}}\p{{L}}*', '\1x', 'g') AS k, {_MASKED.format('§')} AS g FROM h)
SELECT doc_id, {NORMAL.format('t')} AS template_key, {NORMAL.format('k')} AS skeleton, regexp_replace(lower(g), '\d', '#', 'g') AS masked, replace(replace(strip_accents(x), 'đ', 'd'), 'Đ', 'D') AS folded FROM m""")
def note_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template key, skeleton, masked template and case-keeping fold of notes with a span."""
    x, s, e = F.col("x"), F.col("s"), F.col("e")
    return heads(spark, sf_dir).select(
        "doc_id", T.template_key(x, s, e).alias("template_key"), K.skeleton(x, s, e).alias("skeleton"), K.masked_template(x, s, e).alias("masked"), K.fold_keep_case(x).alias("folded"))


_SIGNATURES = (("50k", "<num>k"), ("50 K", "<num> K"), ("1tr5", "<num>tr<num>"), ("1.5tr", "<dec.>tr"), ("1,5tr", "<dec,>tr"), ("1.500.000", "<dot3>"), ("612,000", "<com3>"), ("1500000", "<long>"), ("2 triệu", "<num> trieu"), ("80.000đ", "<dot3>đ"))


@query("SELECT span, signature FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SIGNATURES) + ") t(span, signature)")
def amount_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of literal amounts."""
    return spark.createDataFrame([(a,) for a, _ in _SIGNATURES], "span string").select("span", K.pattern_signature(F.col("span")).alias("signature"))


@query(rf"""WITH {_HEAD}, v AS (SELECT doc_id, unnest(['lower_span', 'plain', 'plain_lower', 'glued', 'plain_span']) AS kind, unnest([substr(x, 1, s) || lower(substr(x, s + 1, e - s)) || substr(x, e + 1), replace(replace(strip_accents(x), 'đ', 'd'), 'Đ', 'D'),
  lower(replace(replace(strip_accents(x), 'đ', 'd'), 'Đ', 'D')), regexp_replace(x, '(\d) (tr|triệu|k|nghìn|ngàn|củ|tỷ)\b', '\1\2', 'g'), substr(x, 1, s) || replace(replace(strip_accents(substr(x, s + 1, e - s)), 'đ', 'd'), 'Đ', 'D') || substr(x, e + 1)]) AS variant, x FROM h)
SELECT doc_id, kind, sha256(variant) AS variant_id FROM v WHERE variant <> x""")
def note_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to write a note otherwise that differs from the note."""
    made = K.variants(F.col("x"), F.col("s"), F.col("e"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("variant")) for k, v in made.items()])
    return heads(spark, sf_dir).select("doc_id", "x", F.inline(rows)).where("variant <> x").select("doc_id", "kind", F.sha2("variant", 256).alias("variant_id"))


@query(r"""WITH d AS (SELECT doc_id, lang, source, text, length(text) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT *, list_filter([CASE WHEN n < 100 THEN 'short' END, CASE WHEN n > 5000 THEN 'long' END, CASE WHEN regexp_matches(text, '\d') THEN 'digits' END,
  CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'accented' END, CASE WHEN contains(text, '!!') THEN 'marks' END], lambda x: x IS NOT NULL) AS strata FROM d)
SELECT doc_id, strata, COALESCE(strata[1], 'none') AS first, list_sum(list_transform(list_append(strata, 'none'), lambda s: CASE s WHEN 'long' THEN 3 WHEN 'digits' THEN 2 WHEN 'marks' THEN 2 WHEN 'none' THEN 0 ELSE 1 END))::INT AS difficulty FROM f""")
def note_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strata of a text, the first in priority, and a difficulty that weighs them."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    t, n = F.col("text"), F.length("text")
    strata = F.array_compact(F.array(
        F.when(n < 100, "short"), F.when(n > 5000, "long"), F.when(t.rlike(r"\d"), "digits"), F.when(T.accented(t), "accented"), F.when(t.contains("!!"), "marks")))
    told = d.select("doc_id", strata.alias("strata"))
    weight = lambda s: F.when(s == "long", 3).when(s.isin("digits", "marks"), 2).otherwise(1)
    return told.select("doc_id", "strata", F.coalesce(F.get("strata", F.lit(0)), F.lit("none")).alias("first"), F.aggregate("strata", F.lit(0), lambda a, s: a + weight(s)).alias("difficulty"))


_ROLES = (("call 0912345678 at 10:30", "phone,time"), ("$20 on 5/6", "money,date"), ("50% of 30kg", "percent,measure"), ("the 3rd in 1999", "ordinal,year"), ("7 and 12", "plain,plain"), ("none", ""))


@query("SELECT note, roles FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ROLES) + ") t(note, roles)")
def number_role_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of numbers in literal notes."""
    notes = spark.createDataFrame([(a,) for a, _ in _ROLES], "note string")
    return notes.select("note", F.array_join(F.transform(K.number_roles(F.col("note")), lambda m: m["role"]), ",").alias("roles"))


@query()
def number_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often numbers have each role, and how many documents hold several, by source."""
    found = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d")).select("source", "doc_id", K.number_roles(F.col("text")).alias("found"))
    return found.select("source", F.explode("found.role").alias("role")).groupBy("source", "role").agg(F.count(F.lit(1)).alias("n"))


_CLASSES = "['de', 'en', 'es', 'fr']"


@query(f"""WITH p AS (SELECT doc_id, lang, [CASE WHEN lang = 'de' THEN 0.5 ELSE 0.25 END, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.2 END, 0.25, 0.1]::DOUBLE[] AS p, doc_id % 11 = 0 AS override FROM documents),
q AS (SELECT *, list_position(p, list_max(p)) AS best FROM p)
SELECT doc_id, CASE WHEN override THEN 'fr' ELSE {_CLASSES}[best] END AS type, CASE WHEN override THEN [0.05 / 3, 0.05 / 3, 0.05 / 3, 0.95]::DOUBLE[] ELSE p END AS probs, p[best] >= 0.5 AS trusted FROM q""")
def soft_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest class, the first among equals, with a rule that overrides it and shares the rest evenly."""
    names = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    p = F.array(F.when(F.col("lang") == "de", 0.5).otherwise(0.25), F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.2), F.lit(0.25), F.lit(0.1))
    told = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"), (F.col("doc_id") % 11 == 0).alias("over"))
    at = F.array_position("p", F.array_max("p")).cast("int")
    rest = F.array(*[F.lit(0.05) / 3] * 3, F.lit(0.95))
    return told.select("doc_id", F.when(F.col("over"), "fr").otherwise(F.element_at(names, at)).alias("type"), F.when(F.col("over"), rest).otherwise(F.col("p")).alias("probs"), (F.array_max("p") >= 0.5).alias("trusted"))


_UNITS = (("2 củ rưỡi", "cu"), ("5 xị", "xi"), ("3 lít", "lit"), ("50 cành", "canh"), ("1 tỏi", "toi"), ("45k", None), ("", None))


@query("SELECT span, unit FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in _UNITS) + ") t(span, unit)")
def slang_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slang unit of literal spans."""
    return spark.createDataFrame([(a,) for a, _ in _UNITS], "span string").select("span", K.slang_unit(F.col("span")).alias("unit"))


@query("""SELECT lang, 'Language ' || COALESCE(lang, 'none') || ' has ' || count(*) || ' documents, {{unknown}} stays' AS line FROM documents GROUP BY lang""")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report line from a template."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    line = K.render(F.lit("Language {{lang}} has {{n}} documents, {{unknown}} stays"), {"lang": F.coalesce("lang", F.lit("none")), "n": F.col("n")})
    return counts.select("lang", line.alias("line"))


@query(r"""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 0 THEN ' ' ELSE 'why' END AS note, regexp_extract(text, '[A-Za-z]{4,}') AS word, doc_id % 40 AS claimed, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, word, CASE WHEN substr(text, claimed + 1, length(word)) = word THEN claimed WHEN word = '' THEN NULL ELSE position(word IN text) - 1 END AS start, CASE WHEN trim(note) <> '' THEN note END AS note FROM l""")
def normalised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with repaired offsets and without blank notes: a claimed place that is wrong gives way to the first right one."""
    l = table(spark, sf_dir, "documents").where("text is not null").select(  # noqa: E741
        "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 5 == 0, " ").otherwise("why").alias("note"), F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("word"), (F.col("doc_id") % 40).alias("claimed"))
    right = F.substring(F.col("text"), (F.col("claimed") + 1).cast("int"), F.length("word")) == F.col("word")
    first = (F.expr("locate(word, text)") - 1).cast("long")
    return l.select("doc_id", "word", F.when(right, F.col("claimed")).when(F.col("word") != "", first).alias("start"), F.when(F.btrim("note") != "", F.col("note")).alias("note"))
