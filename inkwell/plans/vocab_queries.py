"""Queries over a byte-level vocabulary file and over words as pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import vocabulary as V
from inkwell.plans.catalogue import query
from inkwell.session import table

_WORDS = "w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents), b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS piece FROM benchmark)"


def words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).select(F.lower("w").alias("word"))


@query("""SELECT chr(c::INT) AS byte_char, upper(hex(encode(chr(c::INT)))) AS hex FROM range(33, 127) t(c)""")
def visible_byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that stand for themselves in the byte alphabet, by way of tokens."""
    return spark.range(33, 127).select(F.char("id").alias("byte_char")).select("byte_char", V.token_hex(F.col("byte_char")).alias("hex"))


@query(f"""WITH RECURSIVE {_WORDS}, v AS (SELECT word, min(length(word)) AS n FROM w GROUP BY word), p AS (SELECT piece AS t FROM b WHERE length(piece) <= 3 UNION SELECT chr(c::INT) FROM range(97, 123) x(c)),
g(word, n, pos, k) AS (SELECT word, n, 0::BIGINT, 0 FROM v UNION ALL SELECT word, n, pos + (SELECT max(l) FROM (VALUES (1), (2), (3)) s(l) WHERE pos + l <= n AND substr(word, (pos + 1)::INT, l) IN (SELECT t FROM p)), k + 1 FROM g WHERE pos < n)
SELECT word, max(k)::INT AS n_pieces FROM g GROUP BY word""")
def greedy_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces the longest match from the left gives each distinct word."""
    short = words(spark, sf_dir, "benchmark").where("length(word) <= 3").distinct()
    pieces = frozenset(r.word for r in short.collect()) | frozenset("abcdefghijklmnopqrstuvwxyz")  # of three letters at most, so 18,278 pieces bound it
    return words(spark, sf_dir, "documents").distinct().select("word", F.size(V.greedy_pieces(F.col("word"), pieces, prefix="")).alias("n_pieces"))


@query(f"""WITH {_WORDS}, k AS (SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id FROM b), c AS (SELECT id, length(piece) > 3 AS kept, piece FROM k)
SELECT id AS old_id, piece, row_number() OVER (ORDER BY id) - 1 AS new_id FROM c WHERE kept""")
def renumbered_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pruned vocabulary numbered without gaps in its old order, by ranges instead of one sort."""
    from inkwell.operators.ranks import number_rows

    k = number_rows(words(spark, sf_dir, "benchmark").distinct().withColumnRenamed("word", "piece"), "piece", name="old_id")
    return number_rows(k.where("length(piece) > 3"), "old_id", name="new_id").select("old_id", "piece", "new_id")


@query(f"""WITH {_WORDS}, c AS (SELECT word, count(*) AS n FROM w GROUP BY word), d AS (SELECT c.word, c.n, b.piece IS NULL AS unseen FROM c LEFT JOIN b ON word = piece)
SELECT CASE WHEN n = 1 THEN '1' WHEN n < 10 THEN '2-9' WHEN n < 100 THEN '10-99' ELSE '100+' END AS bucket, count(*) AS n_words, SUM(n)::BIGINT AS n_uses, count(*) FILTER (WHERE unseen) AS n_unseen, max(n) AS most FROM d GROUP BY bucket""")
def vocabulary_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by how often they occur, and how many a vocabulary lacks."""
    c = words(spark, sf_dir, "documents").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = words(spark, sf_dir, "benchmark").distinct().withColumn("known", F.lit(True))
    n = F.col("n")
    return c.join(known, "word", "left").groupBy(F.when(n == 1, "1").when(n < 10, "2-9").when(n < 100, "10-99").otherwise("100+").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_uses"), F.count_if(F.col("known").isNull()).alias("n_unseen"), F.max("n").alias("most"))


@query("""SELECT vec_id, list_sort(list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'s': -round(embedding[i]::DOUBLE, 2), 'i': i - 1}))[1:4], lambda x: x.i))::INT[] AS top FROM embeddings""")
def top_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the four largest numbers of each vector, in ascending order."""
    return table(spark, sf_dir, "embeddings").select("vec_id", V.top_ascending(F.transform("embedding", lambda x: F.round(x.cast("double"), 2)), 4).alias("top"))


@query("""SELECT kept::INT AS kept, [i * 11 // (kept - 1) FOR i IN range(0, kept)]::INT[] AS layers FROM range(2, 13) t(kept)""")
def layer_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which of twelve layers each smaller stack comes."""
    return spark.createDataFrame([(k, V.layer_map(12, k)) for k in range(2, 13)], "kept int, layers array<int>")


@query(r"""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL) SELECT c, upper(hex(encode(c))) AS hex,
  CASE WHEN regexp_matches(c, '[0-9]') THEN 'digits_numeric' WHEN regexp_matches(c, '[A-Za-z]') THEN 'ascii_letters' WHEN regexp_matches(c, '^[\x00-\x7F]$') OR c = chr(10) THEN 'ascii_punct_symbols' WHEN regexp_matches(c, '\p{Latin}') THEN 'marked_latin' WHEN regexp_matches(c, '\p{L}') THEN 'non_latin_script' ELSE 'other_symbols' END AS category FROM c WHERE c <> ''""")
def character_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of the corpus with its bytes and category."""
    c = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    return c.select("c", F.hex(F.encode("c", "UTF-8")).alias("hex"), V.category(F.col("c"), F.lit(False), F.lit(False)).alias("category"))
