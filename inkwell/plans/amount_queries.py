"""Queries over amounts: literal notes with their known answers, and every line of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import amounts, numerals, scan
from inkwell.functions import text as T
from inkwell.plans.catalogue import query
from inkwell.plans.text_queries import LINES, lines
from inkwell.session import table

# Notes and the amount that is to be read from them.
VIETNAMESE = (
    ("cơm trưa 45k", "45k", 1, "unit"), ("lương part time 2tr4", "2tr4", 1, "unit"), ("mua laptop 15,5 triệu", "15,5 triệu", 1, "unit"), ("vay Thảo 1 triệu 2 mua gạo", "1 triệu 2", 1, "unit"),
    ("nhờ mẹ 2 củ rưỡi", "2 củ rưỡi", 2, "slang"), ("tiền gas 480.000", "480.000", 1, "grouped"), ("thanh toán 12.345.678 vnđ", "12.345.678 vnđ", 1, "currency"), ("mượn mẹ 5000000 đóng tiền", "5000000", 1, "plain"),
    ("quà hai trăm nghìn", "hai trăm nghìn", 1, "word"), ("mượn chị nửa củ", "nửa củ", 2, "word"), ("cơm tấm 100", "100", 3, "bare"), ("cho a Nam vay 1 triệu 20/10", "1 triệu", 1, "unit"), ("ăn 2 tô phở 70", "70", 3, "bare"),
    ("đổ 5 lít xăng 120k", "120k", 1, "unit"), ("cho anh Tu vay 3 lít sửa xe", "3 lít", 2, "slang"), ("nạp 50k vào 0987 654 321", "50k", 1, "unit"), ("hôm thứ 6 chi 70", "70", 3, "bare"), ("cho Lan 300", "300", 3, "bare"),
    ("họp lúc 10h30", None, None, None), ("mua 2 chai bia", None, None, None), ("trích 20% lương", None, None, None))
ENGLISH = (
    ("venmo mom 50", "50", 1), ("lunch $20 and tip 5", "$20", 3), ("20 bucks for gas", "20 bucks", 3), ("s$30 grab", "s$30", 3), ("rent 1.2k due", "1.2k", 2), ("put 500 in my 401k", "500", 1), ("due in 4 weeks 80", "80", 1),
    ("born 1990", "1990", 0), ("a hundred for shoes", "a hundred", 1), ("at five we met", None, None), ("10:30 call", None, None), ("50% off", None, None), ("twenty quid on beer", "twenty quid", 3))


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


@query(f"SELECT note, value, tier::INT AS tier, kind FROM (VALUES {_values(VIETNAMESE)}) t(note, value, tier, kind)")
def scan_vietnamese_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen amount of literal Vietnamese notes."""
    notes = spark.createDataFrame([(r[0],) for r in VIETNAMESE], "note string")
    return notes.select("note", scan.choose_vietnamese(scan.scan_vietnamese(F.col("note"))).alias("c")).select("note", F.col("c.text").alias("value"), "c.tier", "c.kind")


@query(f"SELECT note, value, tier::INT AS tier FROM (VALUES {_values(ENGLISH)}) t(note, value, tier)")
def scan_english_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen amount of literal English notes."""
    notes = spark.createDataFrame([(r[0],) for r in ENGLISH], "note string")
    return notes.select("note", scan.choose_english(scan.scan_english(F.col("note"))).alias("c")).select("note", F.col("c.text").alias("value"), "c.tier")


@query()
def amounts_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Vietnamese amount of every line of every document, as a span and in dong."""
    told = lines(spark, sf_dir).where(F.col("line").rlike(r"\d")).withColumn("made", scan.compose(F.col("line")))
    chosen = told.select("doc_id", "line_no", "line", "made", scan.choose_vietnamese(scan.scan_vietnamese(F.col("made.text"))).alias("c")).where("c is not null")
    span = chosen.select("doc_id", "line_no", scan.value_span(F.col("line"), F.col("made"), F.col("c")).alias("v"), "c.kind")
    return span.select("doc_id", "line_no", "v.text", "v.start", "v.end", "kind", amounts.amount_to_vnd(F.col("v.text")).alias("vnd"))


@query()
def scan_english_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strict and loose English amount candidate of every line with a digit."""
    found = lines(spark, sf_dir).where(F.col("line").rlike(r"\d")).select("doc_id", "line_no", scan.loose_english(F.col("line")).alias("found"))
    return found.select("doc_id", "line_no", F.inline("found"))


@query(rf"""WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\S+')) AS word FROM lines WHERE regexp_matches(line, '\d'))
SELECT doc_id, line_no::INT AS line_no, count(*) AS n FROM w WHERE regexp_matches(word, '\d') AND regexp_matches(word, '[^()\[\]{{}}<>"''.,;:!?*_]') GROUP BY ALL""")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs with a digit each line has: what the loose candidates have to cover."""
    run = lines(spark, sf_dir).where(F.col("line").rlike(r"\d")).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"[^\t\n\f\r ]+"), 0)).alias("word"))
    return run.where(F.col("word").rlike(r"\d")).groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n"))


_SPANS = (("$20", 20.0), ("20 bucks", 20.0), ("rs 500", 500.0), ("150s$", 150.0), ("twenty five bucks", 25.0), ("50 cents", 0.5), ("2 grand", 2000.0), ("1.2m", 1200000.0), ("quid", None), ("lots", None), ("a hundred quid", 100.0))


@query(f"SELECT span, amount::DOUBLE AS amount FROM (VALUES {_values(_SPANS)}) t(span, amount)")
def english_span_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of literal spans with their currency marks."""
    return spark.createDataFrame([(s,) for s, _ in _SPANS], "span string").select("span", amounts.amount_from_english_span(F.col("span")).alias("amount"))


_READ = (("30 4", "30 4 bday", "30", 30.0), ("5000 rs 4", "paid 5000 rs 4 u", "5000 rs", 5000.0), ("1.80 rn", "1.80 rn", "1.80", 1.8), ("stuff", "stuff for 12", "12", 12.0), ("two hundred x", "two hundred x", "two hundred", 200.0))


@query(f"SELECT note, value, amount::DOUBLE AS amount FROM (VALUES {_values(_READ)}) t(span, note, value, amount)")
def read_english_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans cut back to what reads as an amount, or the note's scan."""
    rows = spark.createDataFrame([r[:2] for r in _READ], "span string, note string")
    return rows.select("note", amounts.read_english_value(F.col("span"), F.col("note")).alias("v")).select("note", "v.value", "v.amount")


_WORDS = (("hai trăm năm mươi", 250), ("mười lăm", 15), ("một trăm linh năm", 105), ("hai trăm năm", 250), ("bảy", 7), ("xe", None))


@query(f"SELECT words, value::BIGINT AS value FROM (VALUES {_values(_WORDS)}) t(words, value)")
def vietnamese_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals below a thousand."""
    return spark.createDataFrame([(w,) for w, _ in _WORDS], "words string").select("words", numerals.vietnamese_number(T.fold(F.col("words"))).alias("value"))


@query(r"""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * (o_totalprice * power(10, (o_orderkey % 8 - 3)::INT)) AS x FROM orders),
v AS (SELECT o_orderkey, x, floor(x + 0.5) AS n, abs(floor(x + 0.5)) AS a FROM p), r AS (SELECT *, floor(a / 1e3 * 10 + 0.5) / 10 AS k, floor(a / 1e6 * 10 + 0.5) / 10 AS m, floor(a / 1e9 * 10 + 0.5) / 10 AS b FROM v)
SELECT o_orderkey, CASE WHEN n < 0 THEN '-' ELSE '' END || CASE WHEN a < 1000 THEN printf('%.0f', a) WHEN a < 1e6 AND k < 1000 THEN replace(regexp_replace(printf('%.1f', k), '\.0$', ''), '.', ',') || 'k'
  WHEN a < 1e9 AND m < 1000 THEN replace(regexp_replace(printf('%.1f', m), '\.0$', ''), '.', ',') || 'tr' ELSE replace(format('{:,}', floor(b)::BIGINT), ',', '.') || CASE WHEN b = floor(b) THEN '' ELSE ',' || right(printf('%.1f', b), 1) END || ' tỷ' END AS vnd FROM r""")
def compact_vnd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all magnitudes in short form."""
    x = F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1) * (F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 8 - 3).cast("double")))
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.format_vnd_compact(x).alias("vnd"))


@query(r"""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * (o_totalprice * power(10, (o_orderkey % 8 - 3)::INT)) AS x FROM orders), r AS (SELECT *, abs(x) AS a, floor(abs(x) / 1e3 * 10 + 0.5) / 10 AS k, floor(abs(x) / 1e6 * 10 + 0.5) / 10 AS m, floor(abs(x) / 1e9 * 10 + 0.5) / 10 AS b FROM p)
SELECT o_orderkey, CASE WHEN x < 0 THEN '-' ELSE '' END || '$' || CASE WHEN a < 1000 THEN regexp_replace(printf('%.2f', floor(a * 100 + 0.5) / 100), '\.00$', '') WHEN a < 1e6 AND k < 1000 THEN regexp_replace(printf('%.1f', k), '\.0$', '') || 'k'
  WHEN a < 1e9 AND m < 1000 THEN regexp_replace(printf('%.1f', m), '\.0$', '') || 'M' ELSE regexp_replace(printf('%.1f', b), '\.0$', '') || 'B' END AS usd FROM r""")
def compact_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all magnitudes in short form."""
    x = F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1) * (F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 8 - 3).cast("double")))
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.format_usd_compact(x).alias("usd"))


_CATS = ("no_candidate", "bare_number", "number_words", "compound_amount", "slang", "decimal_unit", "multi_number", "unusual_punctuation", "unaccented")


@query(f"""WITH c AS (SELECT doc_id, doc_id % 4 <> 1 AS chosen, list_filter({list(_CATS)}, lambda k: (doc_id * (7 + length(k))) % 5 = 0) AS cats FROM documents),
b AS (SELECT *, CASE WHEN list_contains(cats, 'no_candidate') THEN 0.25 WHEN NOT chosen THEN 0.3 WHEN list_contains(cats, 'bare_number') THEN 0.55 WHEN list_contains(cats, 'number_words') THEN 0.65 WHEN list_contains(cats, 'compound_amount') THEN 0.6
  WHEN list_contains(cats, 'slang') THEN 0.7 WHEN list_contains(cats, 'decimal_unit') THEN 0.95 ELSE 0.97 END AS base FROM c)
SELECT doc_id, chosen, round(greatest(CASE WHEN chosen THEN least(base, CASE WHEN list_contains(cats, 'multi_number') THEN 0.6 ELSE 1 END, CASE WHEN list_contains(cats, 'unusual_punctuation') THEN 0.5 ELSE 1 END) - CASE WHEN list_contains(cats, 'unaccented') THEN 0.02 ELSE 0 END ELSE base END, 0), 2)::DOUBLE AS confidence,
  CASE WHEN chosen AND len(cats) = 0 THEN 'auto' ELSE 'review' END AS route FROM b""")
def proposal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's confidence from the categories of its proposal, and whether it may be accepted without review."""
    names = F.array(*map(F.lit, _CATS))
    c = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4 != 1).alias("chosen"), F.filter(names, lambda k: (F.col("doc_id") * (7 + F.length(k))) % 5 == 0).alias("cats"))
    return c.select("doc_id", "chosen", scan.confidence(F.col("chosen"), F.lit(None), F.col("cats")).alias("confidence"), F.when(F.col("chosen") & (F.size("cats") == 0), "auto").otherwise("review").alias("route"))


@query("""SELECT event_id, event_type = 'AbortError' OR regexp_matches(lower(props), '\\baborted\\b') OR (value < 20 AND event_type = 'view') AS benign,
  CASE WHEN user_id % 7 = 0 THEN 'disabled' WHEN user_id % 5 = 0 THEN 'active' WHEN event_id % 3 = 0 THEN 'active' WHEN event_id % 4 = 0 THEN 'evict' ELSE 'cached then update' END AS plan FROM events""")
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise among events, and what a client loads: the active release if nothing or the same is cached, the active one with eviction if the
    cached one is blocked, else the cached one with an update."""
    e = table(spark, sf_dir, "events")
    benign = (F.col("event_type") == "AbortError") | F.lower("props").rlike(r"\baborted\b") | ((F.col("value") < 20) & (F.col("event_type") == "view"))
    plan = (
        F.when(F.col("user_id") % 7 == 0, "disabled").when((F.col("user_id") % 5 == 0) | (F.col("event_id") % 3 == 0), "active").when(F.col("event_id") % 4 == 0, "evict")
        .otherwise("cached then update"))
    return e.select("event_id", benign.alias("benign"), plan.alias("plan"))
