"""Line-first cleaning and document quality rules, in DataFrame operations only.

Every line of a text is judged by itself. A line without a word is kept as layout. Any other fails if
- punctuation: it does not end like a sentence, or holds three or more of ``# * $ % & < > | ! ?`` and more than one
  for every two words;
- navigation: it holds three or more separators ``| » › •``;
- boilerplate: it holds a fixed phrase of notices and page furniture.
Failing lines are removed; a document that loses more than half of its words is rejected, and so is one that fails
the base rules (under ``LEAST_WORDS`` words, or more than 20% of its words in 5-word windows that it repeats).

A window's words are compared through 64-bit hashes first, then themselves; everything happens within a row, so
there is no shuffle, and cost grows with a text's length times its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.native_text import word_count, words

LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20  # percent of words
MOST_LOST = 50  # percent of words
SYMBOLS = "[#*$%&|<>]"

# The patterns of the line rules; they mean the same to Java's and to RE2's regular expressions.
HAS_WORD = r"[^\x20\x09-\x0D]"
SENTENCE_END = r"[.!?…。！？][\x22'”’»)\]]*[\x20\x09-\x0D]*$"
NOISE = r"[#*$%&<>|!?]"
SEPARATOR = r"[|»›•]"
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under the|under the terms of|privacy policy|terms of (use|service)"
    r"|cookie|javascript|lorem ipsum|click here|sign up|log ?in to|subscribe to|powered by|copyright)"
)


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks a rule."""
    noise = F.regexp_count(line, F.lit(NOISE))
    return (
        ~line.rlike(SENTENCE_END)
        | ((noise >= 3) & (noise * 2 > F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))))
        | (F.regexp_count(line, F.lit(SEPARATOR)) >= 3)
        | line.rlike(BOILERPLATE)
    )


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, cleaned (the text without failing lines), lost_words and the base measures of every row.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. A null or empty text has no
    words: all counts are 0, base_failed is true, kept false, cleaned empty. Repeated rows repeat; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    told = _measured(docs, text, keep)
    return told.select(*[F.col(f"doc.`{c}`").alias(c) for c in keep], *[c for c in told.columns if c != "doc"])


def _measured(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` as the struct ``doc``, and the measures."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), t.alias("__t"))
    rows = rows.select("*", words(F.col("__t")).alias("__w"), F.split("__t", "\n").alias("__lines"))
    n = F.size("__w")
    hashes = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)])))
    rows = rows.select(
        "*", hashes.alias("__h"), F.filter("__lines", lambda x: x.rlike(HAS_WORD)).alias("__full"),
        F.array_join(F.filter("__lines", lambda x: ~x.rlike(HAS_WORD) | ~line_fails(x)), "\n").alias("cleaned"))
    ordered = F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", ordered.alias("__s"))

    def twin(x: Column, j: Column) -> Column:
        y = F.get("__s", j)
        same = (y["h"] == x["h"]) & (F.slice("__w", y["i"] + 1, WINDOW) == F.slice("__w", x["i"] + 1, WINDOW))
        return F.coalesce(same, F.lit(False))

    places = F.sort_array(F.transform(
        F.filter("__s", lambda x, j: twin(x, j - 1) | twin(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    rows = rows.select(
        "doc", "cleaned", n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    rows = rows.withColumn("lost_words", F.col("n_words") - word_count(F.col("cleaned"))).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * MOST_LOST))


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with their text cleaned, all columns kept; columns may have any name."""
    told = _measured(docs, "text", tuple(docs.columns)).where("kept")
    return told.select(*[F.col("cleaned").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


MEASURE_SQL = rf"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, string_split(x, chr(10)) AS ls FROM t),
r AS (SELECT doc_id, p, string_agg AS g FROM (
  SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS string_agg FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w))),
twice AS (SELECT doc_id, p FROM r QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM w),
full_lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
  len(regexp_extract_all(line, '{_sql(NOISE)}')) AS noise FROM l WHERE regexp_matches(line, '{_sql(HAS_WORD)}')),
judged AS (SELECT *, NOT regexp_matches(line, '{_sql(SENTENCE_END)}') OR (noise >= 3 AND noise * 2 > len(lw))
  OR len(regexp_extract_all(line, '{_sql(SEPARATOR)}')) >= 3 OR regexp_matches(line, '{_sql(BOILERPLATE)}') AS fails FROM full_lines),
by_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, COALESCE(SUM(CASE WHEN fails THEN len(lw) END), 0)::BIGINT AS lost FROM judged GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(x, '{SYMBOLS}'))::BIGINT AS n_symbols, COALESCE(dups, 0)::BIGINT AS n_dup_lines,
    COALESCE(covered.n, 0)::BIGINT AS n_repeat_words, COALESCE(lost, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN by_doc USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * lost_words <= 50 * n_words AS kept FROM failed
"""
