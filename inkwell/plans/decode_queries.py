"""Queries that decode tags into spans and back. Vectors stand for logits of a text's tokens, three for each; tokens are cuts of three characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import arrays as A
from inkwell.functions import decode as D
from inkwell.functions import spans as S
from inkwell.plans.catalogue import query
from inkwell.session import table

MOVES = [[0.5, 0.0, -9.0], [0.0, -1.0, 0.5], [0.0, 0.0, 0.25]]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, rows (logits), offsets and real of the documents that have a vector. Every seventh token is not real."""
    z = F.transform("embedding", lambda x: F.round(x.cast("double"), 3))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), D.rows_of(z).alias("rows"))
    at = lambda i: F.struct((i * 3).alias("s"), (i * 3 + 3).alias("e"))
    told = e.join(table(spark, sf_dir, "documents").where("length(text) >= 200").select("doc_id", "text"), "doc_id")
    return told.withColumn("offsets", F.transform("rows", lambda r, i: at(i))).withColumn("real", F.transform("rows", lambda r, i: i % 7 != 6))


_NOTES = r"""
z AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS z FROM embeddings),
n AS (SELECT doc_id, text, z, len(z) // 3 AS n FROM z JOIN documents USING (doc_id) WHERE length(text) >= 200),
k AS (SELECT doc_id, text, n, i, i % 7 <> 6 AS ok, z[3 * i + 1] AS a, z[3 * i + 2] AS b, z[3 * i + 3] AS c, 3 * i AS s0, 3 * i + 3 AS e0, substr(text, 3 * i + 1, 3) AS piece FROM (SELECT *, unnest(range(0, n)) AS i FROM n)),
l AS (SELECT *, greatest(a, b, c) + ln(exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) AS norm,
  CASE WHEN length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) = 0 THEN e0 ELSE s0 + 3 - length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS s,
  CASE WHEN length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) = 0 THEN e0 ELSE e0 - 3 + length(rtrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS e FROM k)"""
_TAGGED = """
t AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS tag FROM l)"""
_ISLANDS = """
v AS (SELECT *, CASE tag WHEN 0 THEN a WHEN 1 THEN b ELSE c END - norm AS lp, lag(tag) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM t WHERE s < e),
g AS (SELECT *, SUM(CASE WHEN tag = 1 OR (tag = 2 AND COALESCE(before, 0) = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM v),
sp AS (SELECT doc_id, island::INT AS k, min(s)::INT AS s, max(e)::INT AS e, count(*)::INT AS n_tokens, exp(avg(lp)) AS sure FROM g WHERE tag <> 0 GROUP BY doc_id, island)"""


@query(f"WITH {_NOTES}, {_TAGGED}, {_ISLANDS} SELECT doc_id, k, s, e, n_tokens, round(sure, 6) AS sure FROM sp")
def decode_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of the tags of greatest logit, with its confidence."""
    n = notes(spark, sf_dir).withColumn("tags", D.argmax_tags(F.col("rows"), F.col("real")))
    found = n.select("doc_id", D.spans(D.tokens(F.col("text"), F.col("offsets"), F.col("tags"), F.col("rows"))).alias("spans"))
    one = found.select("doc_id", F.posexplode("spans").alias("k", "x"))
    return one.select("doc_id", (F.col("k") + 1).alias("k"), "x.s", "x.e", F.size("x.members").alias("n_tokens"), F.round(D.confidence(F.col("x")), 6).alias("sure"))


_BEST = """
SELECT n.doc_id, f.s AS first_s, f.e AS first_e, b.s AS best_s, b.e AS best_e, round(COALESCE(b.sure, o.sure, 1.0), 6) AS sure
FROM n LEFT JOIN (SELECT * FROM sp WHERE k = 1) f USING (doc_id) LEFT JOIN (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(sure, 12) DESC, k) = 1) b USING (doc_id)
LEFT JOIN (SELECT doc_id, min(exp(a - norm)) AS sure FROM l WHERE ok GROUP BY doc_id) o USING (doc_id)"""


def _best(n: DataFrame) -> DataFrame:
    told = n.withColumn("spans", D.spans(D.tokens(F.col("text"), F.col("offsets"), F.col("tags"), F.col("rows"))))
    told = told.withColumn("best", D.best_span(F.col("spans"))).withColumn("first", F.get("spans", F.lit(0)))
    sure = F.coalesce(F.when(F.col("best").isNotNull(), D.confidence(F.col("best"))), D.none_confidence(F.col("rows"), F.col("real")))
    return told.select("doc_id", F.col("first.s").alias("first_s"), F.col("first.e").alias("first_e"), F.col("best.s").alias("best_s"), F.col("best.e").alias("best_e"), F.round(sure, 6).alias("sure"))


@query(f"WITH {_NOTES}, {_TAGGED}, {_ISLANDS} {_BEST}")
def decode_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the most confident span of each text, from tags of greatest logit; without a span, how sure that is."""
    return _best(notes(spark, sf_dir).withColumn("tags", D.argmax_tags(F.col("rows"), F.col("real"))))


def _way(j: int) -> str:
    return "[" + ", ".join(f"{{'v': tot[{i + 1}] + {MOVES[i][j]}, 'i': {-i}}}" for i in range(3)) + "]"


_VITERBI = f"""
rl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE ok),
vt(doc_id, p, tot, paths) AS (
  SELECT doc_id, p, [a, b, c], [[0], [1], [2]] FROM rl WHERE p = 1 UNION ALL
  SELECT doc_id, p, [w[1].v + a, w[2].v + b, w[3].v + c], [list_append(paths[1 - w[1].i], 0), list_append(paths[1 - w[2].i], 1), list_append(paths[1 - w[3].i], 2)]
  FROM (SELECT rl.doc_id, rl.p, a, b, c, paths, [list_max({_way(0)}), list_max({_way(1)}), list_max({_way(2)})] AS w FROM vt JOIN rl ON rl.doc_id = vt.doc_id AND rl.p = vt.p + 1)),
pt AS (SELECT doc_id, paths[1 - list_max([{{'v': tot[1], 'i': 0}}, {{'v': tot[2], 'i': -1}}, {{'v': tot[3], 'i': -2}}]).i] AS path FROM vt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) = 1)"""


@query(f"WITH RECURSIVE {_NOTES}, {_VITERBI} SELECT n.doc_id, list_transform(range(0, n), lambda i: CASE WHEN i % 7 <> 6 THEN path[i - i // 7 + 1] ELSE 0 END)::INT[] AS tags FROM n JOIN pt USING (doc_id)")
def viterbi_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tag path over the real tokens of each text."""
    return notes(spark, sf_dir).select("doc_id", D.viterbi_masked(F.col("rows"), F.col("real"), MOVES).alias("tags"))


@query(f"""WITH RECURSIVE {_NOTES}, {_VITERBI}, t AS (SELECT l.*, CASE WHEN ok THEN path[i - i // 7 + 1] ELSE 0 END AS tag FROM l JOIN pt USING (doc_id)), {_ISLANDS} {_BEST}""")
def decode_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the most confident span from the best tag path."""
    return _best(notes(spark, sf_dir).withColumn("tags", D.viterbi_masked(F.col("rows"), F.col("real"), MOVES)))


_WORDS = r"""
w AS (SELECT doc_id, text, doc_id % 40 AS gs, doc_id % 40 + 4 + doc_id % 11 AS ge, unnest(range(0, 24)) AS i FROM documents),
o AS (SELECT *, i <> 0 AND i <> 23 AS ok, 3 * i AS s0, 3 * i + 3 AS e0, substr(text, 3 * i + 1, 3) AS piece FROM w WHERE doc_id % 3 <> 0 AND length(text) >= 72),
x AS (SELECT *, CASE WHEN length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) = 0 THEN e0 ELSE s0 + 3 - length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS s,
  CASE WHEN length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) = 0 THEN e0 ELSE e0 - 3 + length(rtrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS e FROM o),
h AS (SELECT *, s < e AND s < ge AND e > gs AS covered, ok AND s < e AND s < ge AND e > gs AS hit FROM x)"""


@query(f"""WITH {_WORDS}, f AS (SELECT *, min(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id) AS first FROM h)
SELECT doc_id, list(CASE WHEN NOT ok THEN -100 WHEN NOT hit THEN 0 WHEN i = first THEN 1 ELSE 2 END ORDER BY i)::INT[] AS tags, min(s) FILTER (WHERE hit)::INT AS s, max(e) FILTER (WHERE hit)::INT AS e,
  COALESCE(min(s) FILTER (WHERE hit) = any_value(gs) AND max(e) FILTER (WHERE hit) = any_value(ge), false) AS exact, count(*) FILTER (WHERE covered)::INT AS n_covered, list_concat(list(i ORDER BY i) FILTER (WHERE covered), [])::INT[] AS covered FROM f GROUP BY doc_id""")
def encode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span as tags of its text's tokens, the span that these give back, whether it is the same, and the tokens that it covers."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0 and length(text) >= 72").selectExpr("doc_id", "text", "int(doc_id % 40) gs", "int(doc_id % 40 + 4 + doc_id % 11) ge")
    places = F.sequence(F.lit(0), F.lit(23))
    told = docs.withColumn("offsets", F.transform(places, lambda i: F.struct((i * 3).alias("s"), (i * 3 + 3).alias("e")))).withColumn("real", F.transform(places, lambda i: (i != 0) & (i != 23)))
    told = told.withColumn("tags", D.encode_tags(F.col("text"), F.col("offsets"), F.col("real"), F.col("gs"), F.col("ge"))).withColumn("covered", D.token_indices(F.col("text"), F.col("offsets"), F.col("gs"), F.col("ge")))
    flat = F.transform("offsets", lambda o: F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    back = F.get(D.spans(D.tokens(F.col("text"), F.col("offsets"), F.transform("tags", lambda t: F.greatest(t, F.lit(0))), flat)), F.lit(0))
    told = told.withColumn("back", back)
    return told.select(
        "doc_id", "tags", "back.s", "back.e", F.coalesce((F.col("back.s") == F.col("gs")) & (F.col("back.e") == F.col("ge")), F.lit(False)).alias("exact"),
        F.size("covered").alias("n_covered"), "covered")


@query(f"""WITH {_NOTES} SELECT doc_id, n::INT AS width, list_sum(list_transform(z[1:6] || [0.0, 0.0, 0.0, 0.0], lambda x: x)) AS total, (list_transform(range(0, 16 - least(16, n)), lambda i: 1))::INT[] AS fill, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM n""".replace("list_transform(z[1:6] || [0.0, 0.0, 0.0, 0.0], lambda x: x)", "z[1:6]"))
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows padded to a width, with their numbers in order of id."""
    from inkwell.operators.ranks import number_rows

    n = notes(spark, sf_dir).select("doc_id", F.size("rows").alias("width"), F.flatten("rows").alias("z"))
    padded = A.pad(F.slice("z", 1, 6), 10, F.lit(0.0))
    told = n.select("doc_id", "width", A.total(padded).alias("total"), F.array_repeat(F.lit(1), F.lit(16) - F.least(F.lit(16), F.col("width"))).alias("fill"))
    return number_rows(told, "doc_id", name="row")


@query("""WITH v AS (SELECT doc_id, lang, map_from_entries([('en', 0.5), (lang, 0.25 + (doc_id % 4) / 8.0)]) AS m FROM (SELECT * FROM documents WHERE lang <> 'en'))
SELECT doc_id, [COALESCE(m['de'], 0), COALESCE(m['en'], 0), COALESCE(m['es'], 0), COALESCE(m['fr'], 0)]::DOUBLE[] AS dense, [m['de'] IS NOT NULL, m['en'] IS NOT NULL, m['es'] IS NOT NULL, m['fr'] IS NOT NULL] AS there FROM (SELECT doc_id, m FROM v)""".replace("m['", "m['"))
def dense_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of probabilities as vectors in a fixed order of classes, with masks."""
    docs = table(spark, sf_dir, "documents").where("lang <> 'en'")
    m = F.create_map(F.lit("en"), F.lit(0.5), F.col("lang"), F.lit(0.25) + (F.col("doc_id") % 4) / 8.0)
    kinds = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    return docs.select("doc_id", m.alias("m")).select(
        "doc_id", F.transform(kinds, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("dense"), F.transform(kinds, lambda k: F.map_contains_key("m", k)).alias("there"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings), f AS (SELECT vec_id, list_transform(z, lambda x: x + CASE WHEN vec_id % 50 = 0 THEN 0.001 ELSE 0.00001 END) AS y, z FROM e WHERE vec_id % 60 <> 1)
SELECT e.vec_id, CASE WHEN f.vec_id IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM e LEFT JOIN f USING (vec_id)
WHERE f.vec_id IS NULL OR list_max(list_transform(range(1, len(e.z) + 1), lambda i: abs(e.z[i] - f.y[i]))) > 0.0001""")
def compare_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stored table of vectors that a fresh one lacks or gives differently."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    shift = F.when(F.col("vec_id") % 50 == 0, 0.001).otherwise(0.00001)
    f = e.where("vec_id % 60 <> 1").select("vec_id", shift.alias("d"), "z").select("vec_id", F.transform("z", lambda x: x + F.col("d")).alias("y"))
    told = e.join(f, "vec_id", "left").withColumn("gap", F.array_max(F.zip_with("z", "y", lambda a, b: F.abs(a - b))))
    return told.where("y is null or gap > 0.0001").select("vec_id", F.when(F.col("y").isNull(), "missing").otherwise("differs").alias("problem"))


@query("""WITH p AS (SELECT doc_id, lang AS gold_type, CASE WHEN doc_id % 6 = 0 THEN 'en' ELSE lang END AS pred_type, doc_id % 30 AS gs, doc_id % 30 + 5 AS ge, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 30 END AS ps, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN doc_id % 30 + 4 ELSE doc_id % 30 + 5 END AS pe, doc_id % 5 <> 0 AS complete FROM documents)
SELECT doc_id, gold_type IS NOT DISTINCT FROM pred_type AS type_ok, gs IS NOT DISTINCT FROM ps AND ge IS NOT DISTINCT FROM pe AS target_ok, CASE WHEN complete THEN ge IS NOT DISTINCT FROM pe END AS value_ok,
  CASE WHEN complete THEN gold_type IS NOT DISTINCT FROM pred_type AND gs IS NOT DISTINCT FROM ps AND ge IS NOT DISTINCT FROM pe END AS full_joint_ok FROM p""")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each prediction: type, target, and for complete rows value and all together; null where nothing is to be judged."""
    p = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang gold_type", "case when doc_id % 6 = 0 then 'en' else lang end pred_type", "doc_id % 30 gs", "doc_id % 30 + 5 ge",
        "case when doc_id % 4 <> 0 then doc_id % 30 end ps", "case when doc_id % 4 = 0 then null when doc_id % 7 = 0 then doc_id % 30 + 4 else doc_id % 30 + 5 end pe", "doc_id % 5 <> 0 complete")
    kind, target, value = F.col("gold_type").eqNullSafe(F.col("pred_type")), F.col("gs").eqNullSafe(F.col("ps")) & F.col("ge").eqNullSafe(F.col("pe")), F.col("ge").eqNullSafe(F.col("pe"))
    return p.select("doc_id", kind.alias("type_ok"), target.alias("target_ok"), F.when(F.col("complete"), value).alias("value_ok"), F.when(F.col("complete"), kind & target & value).alias("full_joint_ok"))


@query(r"""WITH s AS (SELECT doc_id, text, 3 + doc_id % 40 AS s, 9 + doc_id % 40 AS e FROM documents WHERE length(text) > 60)
SELECT doc_id, s - length(regexp_extract(substr(text, 1, s), '\S*$')) AS snap_s, e + length(regexp_extract(substr(text, e + 1), '^\S*')) AS snap_e, list_transform(range(s, e), lambda i: i) AS chars FROM s""")
def snapped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans moved out to whole words, and the set of their characters."""
    s = table(spark, sf_dir, "documents").where("length(text) > 60").selectExpr("doc_id", "text", "3 + doc_id % 40 s", "9 + doc_id % 40 e")
    a, b = S.snap_to_words(F.col("text"), F.col("s").cast("int"), F.col("e").cast("int"))
    return s.select("doc_id", a.cast("long").alias("snap_s"), b.cast("long").alias("snap_e"), F.sequence("s", F.col("e") - 1).alias("chars"))
