"""Queries over amounts, ingestion round trips and the event gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import amounts
from inkwell.operators.similar import once
from inkwell.plans.catalogue import query
from inkwell.plans.text_queries import lines
from inkwell.session import scratch_path, table
from inkwell.sources import ingest
from inkwell.streaming.gate import gate

NOTES = "VALUES ('coffee 4.50'), ('lent Sam $1,200'), ('rent 2.5k'), ('3 million usd house'), ('20 bucks for 2 tickets'), ('no number'), ('at 10:30 paid 15'), ('room 12a'), ('$5 and 7')"


@query(rf"""
WITH n(note) AS ({NOTES}), t(note, value, amount) AS (VALUES ('coffee 4.50', '4.50', 4.5), ('lent Sam $1,200', '1,200', 1200.0), ('rent 2.5k', '2.5k', 2500.0), ('3 million usd house', '3 million', 3000000.0),
  ('20 bucks for 2 tickets', '20', 20.0), ('no number', NULL, NULL), ('at 10:30 paid 15', '15', 15.0), ('room 12a', NULL, NULL), ('$5 and 7', '5', 5.0))
SELECT note, value, amount::DOUBLE AS amount FROM n JOIN t USING (note)""")
def amounts_en_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English amounts of literal notes."""
    notes = spark.sql(f"SELECT * FROM {NOTES} AS n(note)")
    value = amounts.find_english_value(F.col("note"))
    return notes.select("note", value.alias("value"), amounts.amount_from_english(value).alias("amount"))


@query(r"""
WITH t(written, vnd) AS (VALUES ('60', 60000), ('60k', 60000), ('1tr5', 1500000), ('1tr500k', 1500000), ('2 củ rưỡi', 2500000), ('1.200.000đ', 1200000), ('500 đ', 500), ('2,5 triệu', 2500000), ('3 tỷ', 3000000000), ('$20', NULL), ('abc', NULL), ('1 200 000', 1200000), ('5 lít', 500000))
SELECT written, vnd::BIGINT AS vnd FROM t""")
def amounts_vi_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vietnamese amounts of literal texts."""
    written = ["60", "60k", "1tr5", "1tr500k", "2 củ rưỡi", "1.200.000đ", "500 đ", "2,5 triệu", "3 tỷ", "$20", "abc", "1 200 000", "5 lít"]
    return spark.createDataFrame([(w,) for w in written], "written string").select("written", amounts.amount_to_vnd(F.col("written")).alias("vnd"))


@query()
def amounts_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English amounts of every line of every document."""
    value = amounts.find_english_value(F.col("line"))
    told = lines(spark, sf_dir).where(F.col("line").rlike("[0-9]")).select("doc_id", "line_no", once(value).alias("value")).where("value is not null")
    return told.withColumn("amount", amounts.amount_from_english(F.col("value")))


@query("""SELECT o_orderkey, replace(format('{:,}', round(o_totalprice)::BIGINT), ',', '.') || ' ₫' AS vnd FROM orders""")
def format_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as amounts."""
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.format_vnd(F.round("o_totalprice").cast("long")).alias("vnd"))


@query("""SELECT count(*) AS n, SUM(doc_id)::BIGINT AS ids, SUM(length(text))::BIGINT AS chars FROM documents""")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back."""
    path = scratch_path(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    ingest.write_jsonl(docs, path)
    back = ingest.read_jsonl(spark, path, docs.schema.simpleString()[7:-1].replace(":", " "))
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


@query(r"""
WITH l AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
g AS (SELECT *, row_number() OVER (PARTITION BY nfc_normalize(line) ORDER BY line_no) AS copy FROM l WHERE trim(line) <> '' AND line = trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AND NOT regexp_matches(line, '[\r\t]'))
SELECT CASE WHEN copy > 1 THEN 'copy' ELSE 'first' END AS kind, count(*) AS n, min('p-' || substr(sha256('docs' || chr(0) || 'p' || chr(0) || nfc_normalize(line)), 1, 12)) AS least_id FROM g GROUP BY kind""")
def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document lines through strict text ingestion. (Line order is by document and place; ids don't depend on it.)"""
    numbered = lines(spark, sf_dir).select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_no"), "line")
    records, _ = ingest.ingest(numbered, "docs", "p", "text")
    copy = F.length("id") > 14
    return records.groupBy(F.when(copy, "copy").otherwise("first").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(F.substring("id", 1, 14)).alias("least_id"))


@query(r"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_type || '|' || COALESCE(round(value)::BIGINT::VARCHAR || '.0', '') AS mark, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g(user_id, i, event_id, tokens, last, seen, admitted) AS (
  SELECT user_id, i, event_id, 2.0::DOUBLE, ms, [mark], true FROM e WHERE i = 1 UNION ALL
  SELECT n.user_id, n.i, n.event_id, CASE WHEN n.tried THEN n.bucket - CASE WHEN n.bucket >= 1 THEN 1 ELSE 0 END ELSE n.tokens END, CASE WHEN n.tried THEN n.ms ELSE n.last END, CASE WHEN n.tried AND n.bucket >= 1 THEN list_append(n.seen, n.mark) ELSE n.seen END, n.tried AND n.bucket >= 1
  FROM (SELECT e.*, g.tokens, g.last, g.seen, NOT list_contains(g.seen, e.mark) AND len(g.seen) < 10 AS tried, least(3.0, g.tokens + (e.ms - g.last) / 5000.0) AS bucket FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1) n)
SELECT user_id, event_id, admitted FROM g""")
def error_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event gate over each user's events."""
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.concat_ws("|", "event_type", F.coalesce(F.round("value").cast("string"), F.lit(""))).alias("fingerprint"))
    return gate(events)
