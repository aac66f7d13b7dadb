"""Queries over text keys, ingestion and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.ranks import number_rows
from inkwell.operators.similar import once
from inkwell.plans.catalogue import query
from inkwell.session import table

_FOLD = "replace(strip_accents(lower({0})), 'đ', 'd')"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_MASKED = r"regexp_replace(" + _FOLD + r", '\b\d[\d.,]*\s*(?:k|tr\d*|trieu|nghin|cu|d|%)?($|\W)', ' N \1', 'g')"
NORMAL = _SQUEEZE.format("translate(" + _MASKED + ", ',.', '  ')")
LINES = "lines AS (SELECT doc_id, lang, source, i - 1 AS line_no, ls[i] AS line FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"""
WITH {LINES}, keyed AS (SELECT doc_id, lang, {NORMAL.format('line')} AS k FROM lines WHERE line <> ''),
counted AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM keyed),
docs AS (SELECT doc_id, lang, count(*) AS n_lines, count(*) FILTER (WHERE n > 1) AS n_dup FROM counted GROUP BY ALL)
SELECT lang, count(*) AS n_docs, SUM(n_lines)::BIGINT AS n_lines, SUM(n_dup)::BIGINT AS n_dup_lines,
  round(SUM(n_dup) / SUM(n_lines), 9) AS dup_rate, round(avg(quality), 9) AS quality_rate
FROM docs LEFT JOIN labels USING (doc_id) GROUP BY lang ORDER BY lang""")
def dup_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate lines by normal form, joined with labels, by language."""
    keyed = lines(spark, sf_dir).where("line <> ''").select("doc_id", "lang", T.normalize(F.col("line")).alias("k"))
    by_key = keyed.groupBy("k", "doc_id", "lang").agg(F.count(F.lit(1)).alias("c"))  # before the window: a hot line is one row a document
    counted = by_key.join(by_key.groupBy("k").agg(F.sum("c").alias("n")), "k")
    docs = counted.groupBy("doc_id", "lang").agg(
        F.sum("c").alias("n_lines"), F.sum(F.when(F.col("n") > 1, F.col("c")).otherwise(0)).alias("n_dup"))
    told = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return told.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.sum("n_dup").alias("n_dup_lines"),
        F.round(F.sum("n_dup") / F.sum("n_lines"), 9).alias("dup_rate"), F.round(F.avg("quality"), 9).alias("quality_rate"),
    ).orderBy("lang")


@query("""
WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy,
  source || '-' || substr(sha256(source || chr(31) || text), 1, 12) AS base FROM documents)
SELECT doc_id, base || CASE WHEN copy > 1 THEN '-d' || copy ELSE '' END AS content_id, copy::INT AS copy FROM k""")
def ingest_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from content: source and text hash, and a suffix for the k-th copy. Copies are numbered by a sort over digests, which may spread the copies of one
    text over several tasks; texts are not shuffled."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.concat_ws("-", "source", F.substring(F.sha2(F.concat("source", F.lit("\x1f"), "text"), 256), 1, 12)).alias("base"))
    placed = number_rows(docs, "digest", "doc_id", name="place")
    firsts = placed.groupBy("digest").agg(F.min("place").alias("first"))
    told = placed.join(firsts, placed["digest"].eqNullSafe(firsts["digest"])).select("doc_id", "base", (F.col("place") - F.col("first") + 1).cast("int").alias("copy"))
    return told.select("doc_id", F.when(F.col("copy") > 1, F.concat("base", F.lit("-d"), F.col("copy").cast("string"))).otherwise(F.col("base")).alias("content_id"), "copy")


@query("""
SELECT k AS dropped_key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) WHERE k <> 'text' GROUP BY k""")
def ingest_dropped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of JSON objects other than the kept one, counted."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("dropped_key"))
    return keys.where("dropped_key <> 'text'").groupBy("dropped_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(line) = '') AS n_blank,
  max(length(line)) AS longest, arg_max(line_no, (length(line), -line_no))::INT AS longest_at FROM lines GROUP BY doc_id""")
def text_lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines rolled up by document."""
    return lines(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.btrim("line") == "").alias("n_blank"),
        F.max(F.length("line")).cast("long").alias("longest"),
        F.max_by("line_no", F.struct(F.length("line"), -F.col("line_no"))).alias("longest_at"))


@query(f"""
WITH {LINES}, marked AS (SELECT doc_id, line_no, line, CASE WHEN length(line) < 40 THEN line END AS head FROM lines)
SELECT doc_id, line_no::INT AS line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM marked""")
def section_carry_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last short line above carried down as the section of each line."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    head = F.when(F.length("line") < 40, F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "line_no", F.last(head, ignorenulls=True).over(w).alias("section"))


@query("""
WITH u AS (SELECT text, 0 AS prio, doc_id AS id FROM documents UNION ALL SELECT text, 1, item_id FROM benchmark UNION ALL SELECT text, 2, conv_id * 1000 + turn FROM conversations)
SELECT sha256(text) AS text_key, arg_min(prio, (prio, id))::INT AS prio, arg_min(id, (prio, id)) AS id, count(*) AS n FROM u WHERE text IS NOT NULL GROUP BY text""")
def source_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources united; each text is claimed by the first source that has it."""
    parts = [("documents", 0, "doc_id"), ("benchmark", 1, "item_id"), ("conversations", 2, "conv_id * 1000 + turn")]
    united = None
    for name, prio, key in parts:
        one = table(spark, sf_dir, name).select("text", F.lit(prio).alias("prio"), F.expr(key).alias("id"))
        united = one if united is None else united.unionByName(one)
    first = F.min(F.struct("prio", "id"))
    return united.where("text is not null").groupBy(F.sha2("text", 256).alias("text_key")).agg(first.alias("m"), F.count(F.lit(1)).alias("n")).select(
        "text_key", "m.prio", "m.id", "n")


@query("""
SELECT source, count(*) AS n_rows, SUM(strlen(text))::BIGINT AS n_bytes, min(sha256(text)) AS first_digest, max(sha256(text)) AS last_digest,
  SUM(('0x' || substr(sha256(doc_id || ':' || text), 1, 8))::BIGINT)::BIGINT AS set_digest FROM documents GROUP BY source""")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free content digests by source, for freeze checks."""
    digest = F.sha2("text", 256)
    row = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"),
        F.min(digest).alias("first_digest"), F.max(digest).alias("last_digest"), F.sum(row).alias("set_digest"))


@query(r"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || text WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS source FROM documents)
SELECT doc_id, list_filter([CASE WHEN text IS NULL THEN 'text_missing' END, CASE WHEN text = '' THEN 'text_empty' END,
  CASE WHEN text <> trim(text, chr(32) || chr(10) || chr(9) || chr(13)) THEN 'text_not_trimmed' END, CASE WHEN contains(text, chr(10)) THEN 'text_newline' END,
  CASE WHEN source = '' THEN 'source_empty' END], lambda x: x IS NOT NULL) AS violations FROM b""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken rules of each derived record, in fixed order."""
    bad = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" "), "text")).when(F.col("doc_id") % 11 == 0, "")
        .when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("source")).alias("source"))
    t = F.col("text")
    return bad.select("doc_id", F.array_compact(F.array(
        F.when(t.isNull(), "text_missing"), F.when(t == "", "text_empty"), F.when(t != F.btrim(t, F.lit(" \n\t\r")), "text_not_trimmed"),
        F.when(t.contains("\n"), "text_newline"), F.when(F.col("source") == "", "source_empty"))).alias("violations"))


@query("""
WITH j AS (SELECT l.*, d.text FROM labels l LEFT JOIN documents d USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown_id' WHEN quality NOT IN (0, 1) OR toxic NOT IN (0, 1) THEN 'bad_value'
  WHEN quality = 1 AND toxic = 1 THEN 'conflict' WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM j""")
def label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's first broken rule."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return joined.select("doc_id", (
        F.when(F.col("text").isNull(), "unknown_id").when(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1), "bad_value")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "conflict").when(n > 1, "duplicate").otherwise("ok")).alias("status"))


@query("""
WITH s(status, ord) AS (VALUES ('clean', 1), ('low_quality', 2), ('toxic', 3), ('both', 4), ('unlabelled', 5)),
d AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 AND quality = 0 THEN 'both' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' ELSE 'clean' END AS status
  FROM documents LEFT JOIN labels l USING (doc_id))
SELECT s.status, ord AS ord, count(d.status) AS n FROM s LEFT JOIN d USING (status) GROUP BY ALL""")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled counts over a fixed list of statuses."""
    dims = spark.createDataFrame([("clean", 1), ("low_quality", 2), ("toxic", 3), ("both", 4), ("unlabelled", 5)], "status string, ord int")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(1).alias("has"))
    told = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select((
        F.when(F.col("has").isNull(), "unlabelled").when((F.col("toxic") == 1) & (F.col("quality") == 0), "both")
        .when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").otherwise("clean")).alias("status"))
    return dims.join(told.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", "ord", F.coalesce("n", F.lit(0)).alias("n"))


@query(r"""
SELECT doc_id, list_filter([CASE WHEN length(text) < 60 THEN 'short' END, CASE WHEN length(text) > 5000 THEN 'long' END,
  CASE WHEN regexp_matches(text, '\d{6,}') THEN 'digits' END, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'accented' END,
  CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(lower(text), 'licens') THEN 'licence' END], lambda x: x IS NOT NULL) AS reasons,
  COALESCE(list_filter([CASE WHEN length(text) < 60 THEN 'short' END, CASE WHEN length(text) > 5000 THEN 'long' END,
  CASE WHEN regexp_matches(text, '\d{6,}') THEN 'digits' END], lambda x: x IS NOT NULL)[1], 'none') AS stratum FROM documents""")
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered review reasons; the first hard one is the stratum."""
    t = F.col("text")
    hard = [F.when(F.length(t) < 60, "short"), F.when(F.length(t) > 5000, "long"), F.when(t.rlike(r"\d{6,}"), "digits")]
    soft = [F.when(T.accented(t), "accented"), F.when(t.contains("@"), "mail"), F.when(F.lower(t).contains("licens"), "licence")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(*hard, *soft)).alias("reasons"), F.coalesce(*hard, F.lit("none")).alias("stratum"))


@query(f"""
WITH {LINES} SELECT doc_id, line_no::INT AS line_no, {NORMAL.format('line')} AS normal,
  list_aggregate(list_sort(list_filter(string_split({NORMAL.format('line')}, ' '), lambda w: w <> '' AND w NOT IN ('cho','minh','tao','toi','lai','roi','nha','ok','da','dc','duoc'))), 'string_agg', ' ') AS bag,
  regexp_matches(line, '[^\\x00-\\x7F]') AS accented, {_SQUEEZE.format("regexp_replace(lower(line), '[0-9]+', 'n', 'g')")} AS surface,
  lower(trim(line)) AS exact FROM lines WHERE line <> ''""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of every line. The normal form is a generated column, so that the bag reads it instead of computing it again."""
    x = F.col("line")
    told = lines(spark, sf_dir).where("line <> ''").select("doc_id", "line_no", "line", once(T.normalize(x)).alias("normal"))
    told = told.select("*", once(T.bag_key(F.col("normal"))).alias("bag"))
    return told.select(
        "doc_id", "line_no", "normal", F.when(F.col("bag") != "", F.col("bag")).alias("bag"), T.accented(x).alias("accented"), T.surface_pattern(x).alias("surface"), T.exact_key(x).alias("exact"))


@query("""
WITH p AS (SELECT a.item_id AS a, b.item_id AS b, ' ' || a.text || ' ' AS x, ' ' || b.text || ' ' AS y FROM benchmark a JOIN benchmark b ON a.item_id + 1 = b.item_id),
g AS (SELECT a, b, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS x, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3))) AS y FROM p)
SELECT a, b, round(len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))), 9) AS similarity FROM g""")
def char3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram similarity of neighbouring benchmark items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.char3(F.col("text")).alias("g"))
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return items.join(other, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(T.jaccard(F.col("g"), F.col("h")), 9).alias("similarity"))


@query(r"""
WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT item_id, w, i, unnest(range(1, 5)) AS n FROM s)
SELECT item_id, i::INT AS first_word, n::INT AS n_words, array_to_string(w[i:i + n - 1], ' ') AS gram FROM g WHERE i + n - 1 <= len(w)""")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of one to four words of each benchmark item."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    spans = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("first_word"))
    spans = spans.select("*", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("n_words")).where("first_word + n_words - 1 <= size(w)")
    return spans.select("item_id", "first_word", "n_words", F.array_join(F.slice("w", F.col("first_word"), F.col("n_words")), " ").alias("gram"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licens|copyright|all rights') THEN 'legal' WHEN regexp_matches(text, '[\w.]+@[\w.]+') THEN 'contact'
  WHEN regexp_matches(text, 'password|api_key|secret') THEN 'secret' WHEN len(string_split(text, '|')) > 5 THEN 'navigation' WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'symbols' ELSE 'prose' END AS family FROM documents""")
def family_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matching family of an ordered rule list."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (
        F.when(F.lower(t).rlike("licens|copyright|all rights"), "legal").when(t.rlike(r"[\w.]+@[\w.]+"), "contact")
        .when(t.rlike("password|api_key|secret"), "secret").when(F.size(F.split(t, r"\|")) > 5, "navigation")
        .when(t.rlike(r"[#*$%&]{3}"), "symbols").otherwise("prose")).alias("family"))


@query(r"""
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, length(regexp_replace(html, '[\w.+-]+@[\w-]+\.[\w.]+', '***', 'g'))::INT AS redacted_chars,
  len(regexp_extract_all(html, '[\w.+-]+@[\w-]+\.[\w.]+'))::INT AS n_mails FROM pages""")
def pii_url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without query, and pages with mail addresses masked."""
    mail = r"[\w.+-]+@[\w-]+\.[\w.]+"
    return table(spark, sf_dir, "pages").select(
        "page_id", T.redact_url(F.col("url")).alias("url"), F.length(F.regexp_replace("html", mail, "***")).alias("redacted_chars"),
        F.regexp_count("html", F.lit(mail)).alias("n_mails"))


@query(r"""
SELECT fingerprint, count(*) AS n, min(event_id) AS first_event FROM (SELECT event_id,
  substr(regexp_replace(regexp_replace(event_type || '|' || props, '\b[0-9a-f]{8,}\b', 'h', 'g'), '\d+', 'n', 'g'), 1, 120) AS fingerprint FROM events) GROUP BY fingerprint""")
def event_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events grouped by folded fingerprint."""
    return table(spark, sf_dir, "events").select("event_id", T.event_fingerprint(F.col("event_type"), F.col("props")).alias("fingerprint")).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, length(text) AS n FROM documents), f AS (SELECT doc_id, lang, len(w) AS n_words, n / greatest(len(w), 1) AS fertility FROM w)
SELECT lang, count(*) AS n_docs, round(avg(n_words), 6) AS mean_words, quantile_cont(n_words, 0.5) AS p50, quantile_cont(n_words, 0.95) AS p95, max(n_words) AS most, round(avg(fertility), 6) AS fertility
FROM f GROUP BY lang""".replace("\\\\x", "\\x"))
def fertility_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and characters for each word by language."""
    told = table(spark, sf_dir, "documents").select("lang", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), F.length("text").alias("c"))
    return told.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_words"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"),
        F.max("n").cast("long").alias("most"), F.round(F.avg(F.col("c") / F.greatest("n", F.lit(1))), 6).alias("fertility"))
