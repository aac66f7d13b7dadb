"""Queries over joins, similarity, ranking, sampling, graphs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import arrays as A
from inkwell.functions import spans as S
from inkwell.functions import text as T
from inkwell.operators import graph, sampling, similar
from inkwell.plans.catalogue import query
from inkwell.plans.text_queries import LINES, NORMAL, lines
from inkwell.session import materialize, release, table


@query("""SELECT l.doc_id, quality, toxic, lang, length(text)::INT AS n FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL""")
def labels_join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined with their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    return table(spark, sf_dir, "labels").where("quality is not null").join(docs, "doc_id").select("doc_id", "quality", "toxic", "lang", "n")


@query("""
WITH auto AS (SELECT doc_id, (length(text) >= 200)::INT AS q FROM documents WHERE source <> 'src0')
SELECT doc_id, COALESCE(l.quality, auto.q) AS quality, CASE WHEN l.doc_id IS NULL THEN 'auto_only' WHEN auto.doc_id IS NULL THEN 'human_only' WHEN l.quality = q THEN 'agreed' ELSE 'human_wins' END AS outcome
FROM labels l FULL JOIN auto USING (doc_id)""")
def reconcile_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels before automatic ones, with the outcome of each id."""
    auto = table(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id", (F.length("text") >= 200).cast("int").alias("q"), F.lit(1).alias("a"))
    human = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("h"))
    outcome = F.when(F.col("h").isNull(), "auto_only").when(F.col("a").isNull(), "human_only").when(F.col("quality") == F.col("q"), "agreed").otherwise("human_wins")
    return human.join(auto, "doc_id", "full").select("doc_id", F.coalesce("quality", "q").alias("quality"), outcome.alias("outcome"))


@query("""
WITH a AS (SELECT doc_id, quality AS x FROM labels WHERE quality = 1), b AS (SELECT doc_id, toxic AS y FROM labels WHERE toxic = 0)
SELECT CASE WHEN x IS NULL THEN 'b_only' WHEN y IS NULL THEN 'a_only' WHEN x = y THEN 'same' ELSE 'differ' END AS kind, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY kind""")
def adjudication_fullouter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellers' rows met by full join."""
    labels = table(spark, sf_dir, "labels")
    a = labels.where("quality = 1").select("doc_id", F.col("quality").alias("x"))
    b = labels.where("toxic = 0").select("doc_id", F.col("toxic").alias("y"))
    kind = F.when(F.col("x").isNull(), "b_only").when(F.col("y").isNull(), "a_only").when(F.col("x") == F.col("y"), "same").otherwise("differ")
    return a.join(b, "doc_id", "full").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS DISTINCT FROM CASE WHEN length(d.text) > 300 THEN 0 END""")
def disagreement_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ, null being a value."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.where(~F.col("toxic").eqNullSafe(F.when(F.col("n") > 300, 0))).drop("n")


@query("""
WITH e AS (SELECT vec_id, unnest([embedding[1] > 0, embedding[2] > 0, embedding[3] > 0]) AS err FROM embeddings)
SELECT vec_id FROM e GROUP BY vec_id HAVING bool_and(err) AND count(*) = 3""")
def nway_shared_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids on which every one of three models errs."""
    errors = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*[F.get("embedding", i) > 0 for i in range(3)])).alias("err"))
    return errors.groupBy("vec_id").agg(F.bool_and("err").alias("all"), F.count(F.lit(1)).alias("n")).where("all and n = 3").select("vec_id")


@query(f"""
WITH {LINES}, d AS (SELECT doc_id, {NORMAL.format('line')} AS k FROM lines WHERE line <> ''), b AS (SELECT item_id, {NORMAL.format("unnest(string_split(text, chr(10)))")} AS k FROM benchmark)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM b JOIN d USING (k) WHERE k <> '' GROUP BY item_id""")
def leakage_exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose lines stand in documents by normal form."""
    keyed = lines(spark, sf_dir).where("line <> ''").select("doc_id", T.normalize(F.col("line")).alias("k"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", T.normalize(F.col("line")).alias("k")).where("k <> ''").distinct()
    return items.join(keyed.distinct(), "k").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_DOC_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
_CLASSES = r"""
s AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS t FROM documents),
c AS (SELECT min(doc_id) AS rep, t FROM s WHERE len(t) > 0 GROUP BY t),
p AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.t, b.t)) AS n, len(a.t) + len(b.t) AS m FROM c a JOIN c b ON a.rep < b.rep AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t)),
pairs AS (SELECT a, b, n / (m - n) AS similarity FROM p WHERE n > 0 AND n / (m - n) >= 0.8)"""


_SHARED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _document_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Membership and representative pairs of documents with similar word sets, made once for each application and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.words(F.lower("text")).alias("tokens"))
        _SHARED[key] = similar.similar_sets(docs, 0.8)
    return _SHARED[key]


@query(rf"WITH {_CLASSES} SELECT a, b, round(similarity, 9) AS similarity FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of documents with similar word sets, by their least doc_id; ``near_dup_members`` has the classes."""
    return _document_classes(spark, sf_dir)[1].select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(rf"""WITH {_CLASSES}, e AS (SELECT a AS rep, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs), k AS (SELECT rep, count(*) AS n FROM e GROUP BY rep)
SELECT doc_id, c.rep, COALESCE(k.n, 0) AS n_links FROM s JOIN c USING (t) LEFT JOIN k USING (rep)""")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a word, the least doc_id of equal word set, and how many other classes that set is similar to."""
    members, pairs = _document_classes(spark, sf_dir)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "rep", "left").select(F.col("id").alias("doc_id"), "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')))"


@query(rf"""
WITH b AS (SELECT item_id, {_SHINGLES} AS t FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark)),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS n, len(a.t) + len(b.t) AS m FROM b a, b WHERE a.item_id <= b.item_id)
SELECT a, b, round(n / (m - n), 9) AS similarity FROM p WHERE n > 0 AND n / (m - n) >= 0.5""")
def leakage_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that share word shingles."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.words(F.lower("text")).alias("w"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " ")))
    items = w.select("id", grams.alias("tokens"))
    return similar.set_similarity_join(items, items, 0.5).where("a <= b").select("a", "b", F.round("similarity", 9).alias("similarity"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(rf"""
WITH d AS (SELECT doc_id, text, {_SHINGLES} AS t FROM (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
b AS (SELECT item_id, text AS item, {_SHINGLES} AS t FROM (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT doc_id, text, d.n, item_id, item, b.n AS m, count(*) AS c FROM (SELECT *, len(t) AS n, unnest(t) AS k FROM d) d JOIN (SELECT *, len(t) AS n, unnest(t) AS k FROM b) b USING (k) GROUP BY ALL)
SELECT doc_id, item_id, round(c / (n + m - c), 9) AS similarity FROM p WHERE c / (n + m - c) >= 0.5""")
def leakage_jaccard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share most of their word shingles with a benchmark item."""
    w = similar.once(T.words(F.lower("text"))).alias("w")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get("w", i + k) for k in range(3)]))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), w)
    items = table(spark, sf_dir, "benchmark").select("item_id", w)
    found = similar.set_similarity_to_items(
        docs.where("size(w) > 0").withColumn("tokens", grams), items.where("size(w) > 0").withColumn("tokens", grams), 0.5)
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 9).alias("similarity"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of each query vector (ids divisible by 100), against all rows."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    score = F.when(F.col("vec_id") != F.col("query_id"), A.cosine(F.col("q"), F.col("embedding").cast("array<double>")))
    return similar.top_matches(queries, e, 5, "query_id", "vec_id", score).withColumn("score", F.round("score", 6))


@query("""
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::INT AS e FROM lineitem)
SELECT x.k, x.i, y.i AS j, greatest(0, least(x.e, y.e) - greatest(x.s, y.s))::INT AS shared FROM a x JOIN a y ON x.k = y.k AND x.i < y.i AND x.s < y.e AND y.s < x.e""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals within an order."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e"))
    x, y = a.alias("x"), a.alias("y")
    met = (F.col("x.k") == F.col("y.k")) & (F.col("x.i") < F.col("y.i")) & (F.col("x.s") < F.col("y.e")) & (F.col("y.s") < F.col("x.e"))
    return x.join(y, met).select("x.k", "x.i", F.col("y.i").alias("j"), S.overlap(F.col("x.s"), F.col("x.e"), F.col("y.s"), F.col("y.e")).alias("shared"))


@query("""
WITH p AS (SELECT vec_id, embedding[1] > 0 AS a, embedding[2] > 0 AS b FROM embeddings) SELECT CASE WHEN a AND b THEN 'both_right' WHEN a THEN 'broken' WHEN b THEN 'fixed' ELSE 'both_wrong' END AS kind, count(*) AS n, min(vec_id) AS first FROM p GROUP BY kind""")
def paired_diff_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' correctness joined by id and partitioned."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", (F.get("embedding", 0) > 0).alias("a")), e.select("vec_id", (F.get("embedding", 1) > 0).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "both_right").when(F.col("a"), "broken").when(F.col("b"), "fixed").otherwise("both_wrong")
    return a.join(b, "vec_id").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))


@query("""
WITH patch AS (SELECT doc_id, CASE WHEN quality = 0 THEN NULL ELSE 1 - quality END AS new, quality = 0 AS clear FROM labels WHERE toxic = 1)
SELECT doc_id, CASE WHEN clear THEN NULL ELSE COALESCE(new, quality) END AS quality, toxic FROM labels LEFT JOIN patch USING (doc_id)""")
def patch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relabelled values over old ones, an explicit null included."""
    labels = table(spark, sf_dir, "labels")
    clear = F.col("quality") == 0
    patch = labels.where("toxic = 1").select("doc_id", F.when(~clear, 1 - F.col("quality")).alias("new"), clear.alias("clear"))
    value = F.when(~F.coalesce("clear", F.lit(False)), F.coalesce("new", "quality"))
    return labels.join(patch, "doc_id", "left").select("doc_id", value.alias("quality"), "toxic")


@query("""
SELECT doc_id, list_filter([CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' END, CASE WHEN text IN (SELECT text FROM benchmark) THEN 'benchmark' END, CASE WHEN source IN ('src3', 'src7') THEN 'source' END], lambda x: x IS NOT NULL) AS reasons FROM documents""")
def semi_anti_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulated reasons from several membership tests."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("t")).distinct()
    known = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("h"), F.lit(1).alias("b")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return docs.join(toxic, "doc_id", "left").join(known, "h", "left").select("doc_id", F.array_compact(F.array(
        F.when(F.col("t") == 1, "toxic"), F.when(F.col("b") == 1, "benchmark"), F.when(F.col("source").isin("src3", "src7"), "source"))).alias("reasons"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY sha256('seed:' || doc_id))::INT AS position FROM documents WHERE lang = 'en' ORDER BY position LIMIT 50""")
def seeded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 rows in seeded hash order."""
    return sampling.queue(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "seed", 50)


@query("""SELECT doc_id, row_number() OVER (ORDER BY sha256('next:' || doc_id))::INT AS position FROM documents ANTI JOIN labels USING (doc_id) ORDER BY position LIMIT 30""")
def next_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next unreviewed rows in hash order."""
    left = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return sampling.queue(left, "doc_id", "next", 30)


@query("""
WITH s AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS population FROM documents)
SELECT source, doc_id, population, row_number() OVER (PARTITION BY source ORDER BY sha256('audit:' || doc_id))::INT AS position FROM s
QUALIFY position <= CASE WHEN population <= 2 THEN population WHEN population >= 6 THEN 3 ELSE 2 END""")
def stratum_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three rows of each stratum, by its size."""
    n = F.when(F.col("population") <= 2, F.col("population")).when(F.col("population") >= 6, 3).otherwise(2)
    return sampling.quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "audit", n)


@query("""
WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS round, min(doc_id) OVER (PARTITION BY source, lang) AS first FROM documents)
SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY round, first)::INT AS position FROM r QUALIFY position <= 8""")
def round_robin_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows of each source, its languages in turn."""
    return sampling.round_robin(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id", 8)


@query("""
WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('split:' || o_custkey), o_custkey) AS i, count(*) OVER () AS n FROM g)
SELECT o_custkey, CASE WHEN i <= round(n * 0.1) THEN 'test' WHEN i <= round(n * 0.1) + round(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to splits by hash order."""
    return sampling.split_groups(table(spark, sf_dir, "orders"), "o_custkey", "split")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1""")
def argmax_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's largest order, the lowest key among equals: an aggregate, not a sort."""
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", (-F.col("b.k")).alias("o_orderkey"), "b.o_totalprice")


@query(f"""
WITH {LINES}, v AS (SELECT doc_id, line_no, unnest([lower(line), strip_accents(line), replace(strip_accents(lower(line)), 'đ', 'd')]) AS variant, unnest([1, 2, 3]) AS kind, line FROM lines WHERE line <> '')
SELECT doc_id, line_no::INT AS line_no, kind::INT AS kind, variant FROM v WHERE variant <> line QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, variant ORDER BY kind) = 1 AND row_number() OVER (PARTITION BY doc_id, line_no ORDER BY kind) <= 2""")
def variants_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two distinct variants of each line."""
    x = F.col("line")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("variant")) for k, v in ((1, F.lower(x)), (2, T.strip_accents(x)), (3, T.fold(x)))])
    rows = lines(spark, sf_dir).where("line <> ''").select("doc_id", "line_no", "line", F.inline(kinds)).where("variant <> line")
    by = Window.partitionBy("doc_id", "line_no")
    told = rows.withColumn("a", F.row_number().over(Window.partitionBy("doc_id", "line_no", "variant").orderBy("kind"))).withColumn("b", F.row_number().over(by.orderBy("kind")))
    return told.where("a = 1 and b <= 2").select("doc_id", "line_no", "kind", "variant")


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_DOC_WORDS} AS t FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS n, len(a.t) + len(b.t) AS m FROM d a JOIN d b ON a.doc_id < b.doc_id AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t)),
e AS (SELECT a, b FROM p WHERE n > 0 AND n / (m - n) >= 0.8), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
c(node, root) AS (SELECT x, x FROM s UNION SELECT s.y, c.root FROM c JOIN s ON s.x = c.node AND c.root < s.y)
SELECT node, min(root) AS component FROM c GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of documents with similar word sets; the root is a member too. Classes of equal sets are nodes, so
    their copies are linked by membership alone."""
    members, pairs = _document_classes(spark, sf_dir)
    parts = graph.components(pairs)
    parts = parts.union(parts.select(F.col("component").alias("node"), "component").distinct())
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    told = several.join(parts, F.col("rep") == F.col("node"), "left").where("n > 1 or node is not null")
    return members.join(told.select("rep", F.coalesce("component", "rep").alias("component")), "rep").select(F.col("id").alias("node"), "component")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1), c(child, parent) AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.parent)
SELECT child, parent FROM c""")
def merge_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors over an acyclic parent table, by doubling path lengths."""
    from inkwell.session import materialize

    paths = materialize(table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent")), "paths")
    before = -1
    while (n := paths.count()) != before:
        before = n
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.parent") == F.col("y.child")).select("x.child", "y.parent")
        paths = materialize(paths.union(longer).distinct(), "paths")
    return paths


@query("""
WITH s AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, SUM(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
SELECT conv_id, island::BIGINT AS island, any_value(role) AS role, min(turn) AS first_turn, count(*) AS n_turns FROM i GROUP BY conv_id, island""")
def bio_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal roles: gaps and islands."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = (~F.lag("role").over(w).eqNullSafe(F.col("role"))).cast("int")
    rows = table(spark, sf_dir, "conversations").withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"))


@query(r"""
WITH s AS (SELECT doc_id, text, length(text) // 3 AS a, length(text) // 2 AS b FROM documents), t AS (SELECT *, a - length(regexp_extract(substr(text, 1, a), '(\S*)$', 1)) AS s, b + length(regexp_extract(substr(text, b + 1), '^(\S*)', 1)) AS e FROM s)
SELECT doc_id, s::INT AS s, e::INT AS e, substr(text, s + 1, e - s) AS span FROM t""")
def word_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans moved out to word edges."""
    docs = table(spark, sf_dir, "documents")
    s, e = S.snap_to_words(F.col("text"), F.expr("int(length(text) div 3)"), F.expr("int(length(text) div 2)"))
    return docs.select("doc_id", s.alias("s"), e.alias("e"), S.slice_of(F.col("text"), s, e).alias("span"))


@query("""
WITH t(event_type) AS (SELECT DISTINCT event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS i FROM events)
SELECT event_type, count(*) AS n, round(SUM(COALESCE(value, 0)), 4) AS total, max(event_id) FILTER (WHERE i = 1) AS latest FROM r GROUP BY event_type""")
def stack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum and latest event by type."""
    latest = F.max(F.struct("ts", (-F.col("event_id")).alias("i")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"), latest.alias("m")).select("event_type", "n", "total", (-F.col("m.i")).alias("latest"))


@query("""
SELECT user_id, round(SUM(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS inflow, round(SUM(CASE WHEN event_type <> 'purchase' THEN value ELSE 0 END), 4) AS outflow,
  round(SUM(CASE WHEN event_type = 'purchase' THEN value ELSE -value END), 4) AS net FROM events GROUP BY user_id""")
def cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed roll-up by user."""
    buy, v = F.col("event_type") == "purchase", F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.sum(F.when(buy, v).otherwise(0)), 4).alias("inflow"), F.round(F.sum(F.when(~buy, v).otherwise(0)), 4).alias("outflow"), F.round(F.sum(F.when(buy, v).otherwise(-v)), 4).alias("net"))


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key; the earlier id stays among equals."""
    newest = F.max(F.struct("ts", (-F.col("event_id")).alias("i"), "event_type", "value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest.alias("m")).select("user_id", (-F.col("m.i")).alias("event_id"), "m.event_type", "m.value")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows: the batch twin of the streaming aggregate."""
    from inkwell.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM i GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of 30 minutes: the batch twin of the streaming aggregate."""
    from inkwell.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("""
SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) = (SELECT (q.ts, q.event_id) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND (q.ts, q.event_id) <= (e.ts, e.event_id) ORDER BY q.ts DESC, q.event_id DESC LIMIT 1) GROUP BY e.event_id""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's last purchase by the same user at or before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    buy = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.last(buy, ignorenulls=True).over(w).alias("last_purchase"))


@query()
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy diverse choice of five documents of each source, by language and length class."""
    rows = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.array(F.col("lang"), F.concat(F.lit("len"), F.length(F.bin(F.length("text"))).cast("string"))).alias("features"))
    return sampling.diverse_sample(rows, "source", "doc_id", "features", 5, "diverse")


@query(rf"""
WITH RECURSIVE {_CLASSES}, ids AS (SELECT rep, row_number() OVER (ORDER BY rep) AS i FROM (SELECT a AS rep FROM pairs UNION SELECT b FROM pairs)),
walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT walk.i + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE b = ids.rep AND list_contains(kept, a)) THEN kept ELSE list_append(kept, ids.rep) END FROM walk JOIN ids ON ids.i = walk.i + 1),
last AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)
SELECT doc_id AS id FROM s WHERE len(t) = 0 OR t IS NULL UNION ALL SELECT rep FROM c WHERE rep NOT IN (SELECT rep FROM ids) UNION ALL SELECT unnest(kept) FROM last""")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sequential keep-first pass over documents with similar word sets keeps: of a class of equal sets the first at most."""
    members, pairs = _document_classes(spark, sf_dir)
    wordless = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(members, "id", "left_anti")
    return similar.keep_first(members.select(F.col("rep").alias("id")).distinct(), pairs).union(wordless)


@query(r"""
WITH d AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents), q AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark),
dt AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY ALL), qt AS (SELECT item_id, w, count(*) AS tf FROM q GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM dt GROUP BY w), n AS (SELECT count(*) AS n FROM documents),
dw AS (SELECT doc_id, w, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM dt JOIN f USING (w), n), qw AS (SELECT item_id, w, tf * (ln((1 + n) / (1 + COALESCE(df, 0))) + 1) AS x FROM qt LEFT JOIN f USING (w), n),
dn AS (SELECT doc_id, sqrt(SUM(x * x)) AS l FROM dw GROUP BY doc_id), qn AS (SELECT item_id, sqrt(SUM(x * x)) AS l FROM qw GROUP BY item_id),
s AS (SELECT item_id, doc_id, SUM(qw.x * dw.x) AS p FROM qw JOIN dw USING (w) GROUP BY ALL), r AS (SELECT item_id, doc_id, round(p / (qn.l * dn.l), 9) AS score FROM s JOIN qn USING (item_id) JOIN dn USING (doc_id))
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r QUALIFY rank <= 3""")
def tfidf_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to each benchmark item by TF-IDF cosine."""
    tokens = lambda name, key: table(spark, sf_dir, name).select(key, F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), F.lower).alias("tokens"))
    return similar.tfidf_nearest(tokens("benchmark", "item_id"), tokens("documents", "doc_id"), 3, "item_id", "doc_id")


_BAG_SQL = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w NOT IN ('cho', 'minh', 'tao', 'toi', 'lai', 'roi', 'nha', 'ok', 'da', 'dc', 'duoc') AND w <> '')), ' ')"


def _leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group): documents that must stay together, since they share a bag of words in normal form, a set of words, or are similar; the least id names
    the group. Copies are linked to one of them only, so a group of n costs n edges."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    members, pairs = _document_classes(spark, sf_dir)
    bags = materialize(docs.select("doc_id", F.xxhash64(T.bag_key(T.normalize(F.col("text")))).alias("bag")), "bags")
    firsts = bags.groupBy("bag").agg(F.min("doc_id").alias("first"))
    edges = bags.join(firsts, "bag").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).union(members.select("id", "rep")).union(pairs.select("a", "b"))
    parts = graph.components(edges)
    groups = materialize(bags.select("doc_id").join(parts, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.least("doc_id", F.coalesce("component", "doc_id")).alias("group")), "groups")
    for done in (bags, parts):
        release(done)
    return groups


@query(rf"""
WITH RECURSIVE {_CLASSES}, k AS (SELECT doc_id, {_BAG_SQL.format(NORMAL.format('text'))} AS bag FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY bag) AS first FROM k),
e AS (SELECT a, b FROM pairs UNION SELECT doc_id, rep FROM s JOIN c USING (t) UNION SELECT doc_id, first FROM f), y AS (SELECT a AS x, b AS y FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(node, root) AS (SELECT doc_id, doc_id FROM k UNION SELECT y.y, r.root FROM r JOIN y ON y.x = r.node AND r.root < y.y)
SELECT node AS doc_id, min(root) AS "group" FROM r GROUP BY node""")
def leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leakage group of every document."""
    return _leakage_groups(spark, sf_dir)


@query()
def document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole leakage groups of documents dealt to splits by language, with every language in each held-out split."""
    from inkwell.operators import selection, splits

    rows = _leakage_groups(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("group", F.coalesce("lang", F.lit("none")).alias("kind"))
    told = splits.leakage_safe_split(rows, "group", "kind", "documents").select("group", "n", "split")
    return selection.ensure_coverage(told, rows)


@query()
def near_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that ties each benchmark item to a document, sequences included."""
    from inkwell.operators import sequences

    return sequences.first_rules(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("r"), "text"))


@query(rf"""
WITH {LINES}, l AS (SELECT lower(line) AS x, min(doc_id) AS first FROM lines WHERE line <> '' GROUP BY lower(line)), b AS (SELECT DISTINCT item_id, lower(unnest(string_split(text, chr(10)))) AS x FROM benchmark),
d AS (SELECT x, unnest(list_distinct(list_transform(range(1, greatest(length(x), 1) + 1), lambda i: substr(' ' || x || ' ', i, 3)))) AS g FROM l), i AS (SELECT DISTINCT x, unnest(list_distinct(list_transform(range(1, greatest(length(x), 1) + 1), lambda i: substr(' ' || x || ' ', i, 3)))) AS g FROM (SELECT DISTINCT x FROM b WHERE x <> '')),
dn AS (SELECT x, count(*) AS n FROM d GROUP BY x), bn AS (SELECT x, count(*) AS n FROM i GROUP BY x), c AS (SELECT d.x AS dx, i.x AS ix, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL),
s AS (SELECT dx, ix, c / (dn.n + bn.n - c) AS similarity FROM c JOIN dn ON dn.x = dx JOIN bn ON bn.x = ix WHERE c / (dn.n + bn.n - c) >= 0.5)
SELECT item_id, round(max(similarity), 9) AS similarity, min(first) FILTER (WHERE similarity = best) AS doc_id FROM (SELECT item_id, similarity, first, max(similarity) OVER (PARTITION BY item_id) AS best FROM s JOIN b ON b.x = ix JOIN l ON l.x = dx) GROUP BY item_id""")
def max_char3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's greatest trigram similarity to a line of any document, from 0.5, and the least document with such a line."""
    grams = lambda x: similar.once(T.char3(x)).alias("tokens")
    found = lines(spark, sf_dir).where("line <> ''").groupBy(F.lower("line").alias("x")).agg(F.min("doc_id").alias("id"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("x")).select("item_id", F.lower("x").alias("x")).where("x <> ''").distinct()
    pairs = similar.set_similarity_to_items(found.select("id", F.xxhash64("x").alias("th"), grams(F.col("x"))), items.select("item_id", grams(F.col("x"))), 0.5)
    best = F.max(F.struct("similarity", (-F.col("id")).alias("i")))
    return pairs.groupBy("item_id").agg(best.alias("m")).select("item_id", F.round("m.similarity", 9).alias("similarity"), (-F.col("m.i")).alias("doc_id"))
