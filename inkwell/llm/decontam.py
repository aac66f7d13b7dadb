"""Benchmark decontamination in DataFrame operations only.

A benchmark item of n words is looked for in windows of n words of every document. Shingles are five
words, lower-cased (a shorter item is one shingle). A window and an item are similar when the weighted
Jaccard similarity of their shingles, each weighing its number of occurrences, is at least ``THRESHOLD``.

1. Windows: similarity above zero needs a common shingle, and as a window slides its common weight changes only
   where a common shingle enters or leaves. So the best window begins at a shingle of the benchmark, or is the
   document's last. Whole texts are exploded into shingles and joined with the benchmark's; what remains is
   (document, window size, start).
2. Each such window gets a 64-bit SimHash of its shingles; its bits are counted in lanes of a few longs.
3. Windows meet items of their size in a multi-index of eight 8-bit blocks: within ``RADIUS`` = 23 bits some block
   differs in at most two, so every fingerprint within the radius meets. A window of similarity 0.8 is about 10
   bits from its item; it lies beyond 23 with a probability under one in 100,000. That holds for windows of as many distinct shingles as
   their item; others (repeated shingles, documents shorter than the item) meet items by a common shingle instead.
4. The exact weighted similarity decides.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.native_text import words
from inkwell.session import fresh, materialize

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS = 8
WIDTH = 64 // BLOCKS
#: Different benchmark shingles that are broadcast; 16 bytes each.
MOST_WANTED = 1_000_000
LANE = 21  # bits of a counting lane: three lanes in a long hold windows of up to 2 million shingles


def _shingle_hash(array: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(k)])


def _all_hashes(array: Column, k: int) -> Column:
    """The hashes of all k-word shingles in order; empty if there are fewer words."""
    n = F.size(array) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: _shingle_hash(array, i, k))).otherwise(
        F.array().cast("array<bigint>"))


def _lanes(h: Column) -> list[Column]:
    mask = (1 << LANE * 2) | (1 << LANE) | 1
    found = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask))).alias(f"c{j}") for j in range(LANE)]
    return [*found, F.sum(F.shiftrightunsigned(h, 63)).alias("c63")]


def _bits(m: Column) -> Column:
    """The fingerprint: a bit is 1 if it is set in over half of the m shingles."""
    one = lambda count, b: F.when(count * 2 > m, F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0))
    parts = [one(F.col("c63"), 63)]
    for j in range(LANE):
        for lane in range(3):
            count = F.shiftrightunsigned(F.col(f"c{j}"), LANE * lane).bitwiseAND((1 << LANE) - 1)
            parts.append(one(count, j + LANE * lane))
    return reduce(lambda a, b: a.bitwiseOR(b), parts).cast("long")


def simhash(shingles: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """keys and fp from one row for each shingle; partial sums meet by key."""
    counted = shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *_lanes(F.col(h)))
    return counted.select(*keys, _bits(F.col("m")).alias("fp"))


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * b).bitwiseAND((1 << WIDTH) - 1)


def items_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, k, ish, fp) for every item that has a word."""
    told = benchmark.select("item_id", words(F.lower("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    told = told.withColumn("k", F.least(F.col("n"), F.lit(SHINGLE)))
    told = materialize(told.select("item_id", "n", "k", _hashes_by_k(F.col("w"), F.col("k")).alias("ish")).distinct(), "items")
    longest = told.agg(F.max("n")).first()[0] or 0
    if longest >= 1 << LANE:  # a counting lane would overflow into the next
        raise ValueError(f"a benchmark item has {longest} words; fewer than {1 << LANE} can be counted")
    one = told.withColumn("t", F.xxhash64("ish"))
    fps = simhash(one.select(F.col("item_id").alias("i"), F.col("t").alias("j"), F.explode("ish").alias("h")), ["i", "j"])
    return materialize(
        one.join(fps, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("j"))).select("item_id", "n", "k", "ish", "fp"),
        "items")


def _hashes_by_k(array: Column, k: Column) -> Column:
    return reduce(
        lambda rest, n: F.when(k == n, _all_hashes(array, n)).otherwise(rest),
        range(1, SHINGLE), _all_hashes(array, SHINGLE))


def _windows(docs: DataFrame, items: DataFrame, most_wanted: int = MOST_WANTED) -> DataFrame | None:
    """(doc_id, th, n, s, sh): the windows of step 1 with their shingles; s counts words from 0.

    While the benchmark has at most ``most_wanted`` different shingles they are broadcast: the scan, the split into shingles,
    the lookup and the cut of the window are then one stage, and only windows are shuffled. A larger benchmark is
    joined by shuffling the documents' shingles, and the documents that have any are read a second time.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.lower("text")).alias("w"))
    found, wholly = [], True
    for (k,) in items.select("k").distinct().collect():  # five values at most
        wanted = materialize(
            items.where(F.col("k") == k).select("n", F.explode("ish").alias("h")).distinct(), "wanted")
        small = wanted.limit(most_wanted + 1).count() <= most_wanted
        wholly &= small
        shifted = [F.col("w"), *[F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))) for i in range(1, k)]]
        rows = base.where(F.size("w") >= k).select(
            *base.columns, F.posexplode(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])).alias("at", "z"))
        rows = rows.where(F.col(f"z.w{k - 1}").isNotNull()).select(
            *(base.columns if small else ("doc_id", "th", F.size("w").alias("total"))), "at",
            F.xxhash64(*[F.col(f"z.w{i}") for i in range(k)]).alias("h"))
        total = F.size("w") if small else F.col("total")
        start = F.least("at", F.greatest(total - F.col("n"), F.lit(0))).alias("s")
        if small:
            hits = rows.join(F.broadcast(wanted), "h").select("doc_id", "th", "n", start, F.slice("w", start + 1, F.col("n")).alias("ww"))
            found.append(hits.select("doc_id", "th", "n", "s", _all_hashes(F.col("ww"), k).alias("sh"), F.lit(k).alias("k")))
        else:
            hits = rows.join(wanted, "h").select("doc_id", "th", "n", start)
            found.append(hits.select("*", F.lit(None).cast("array<bigint>").alias("sh"), F.lit(k).alias("k")))
    if not found:
        return None
    starts = reduce(DataFrame.union, found).dropDuplicates(["doc_id", "th", "n", "s"])
    if wholly:
        return materialize(starts.drop("k"), "windows")
    starts = materialize(starts, "starts")
    marked = starts.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("k").alias("j")).distinct()
    texts = docs.withColumn("th", F.xxhash64("text"))
    told = texts.join(marked, texts["doc_id"].eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    told = told.select("d", "t", "j", _hashes_by_k(words(F.lower("text")), F.col("j")).alias("hashes")).dropDuplicates(["d", "t", "j"])
    return materialize(
        starts.join(told, starts["doc_id"].eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("k") == F.col("j")))
        .select("doc_id", "th", "n", "s", F.slice("hashes", F.col("s") + 1, F.col("n") - F.col("k") + 1).alias("sh")), "windows")


def _common_weight(a: str, b: str) -> Column:
    """Sum over shingles of the lesser of the occurrences in the arrays a and b."""
    count = lambda array, h: F.size(F.filter(array, lambda x: x == h))
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    return F.when(single, F.size(both)).otherwise(
        F.aggregate(both, F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h))))


def _similar_windows(docs: DataFrame, benchmark: DataFrame, threshold: float, most_wanted: int) -> DataFrame | None:
    """doc_id, th (the text's hash), item_id, s, n and similarity of every similar window; None for a benchmark without words."""
    items = items_table(benchmark)
    windows = _windows(docs, items, most_wanted)
    if windows is None:
        return None
    keys = ["doc_id", "th", "n", "s"]
    marked = simhash(windows.select(*keys, F.explode("sh").alias("h")), keys)
    probes = [reduce(lambda x, y: x ^ y, flips, 0) for r in range(RADIUS // BLOCKS + 1)
              for flips in itertools.combinations([1 << i for i in range(WIDTH)], r)]
    index = items.select(
        "item_id", "n", F.col("fp").alias("ifp"),
        F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("e"),
    ).select("item_id", "n", "ifp", "e.b", F.explode(F.transform(
        F.array(*map(F.lit, probes)), lambda p: F.col("e.v").bitwiseXOR(p))).alias("v"))
    index = materialize(index, "index")
    keyed = marked.select(
        "*", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("e"),
    ).select(*keys, "fp", "e.b", "e.v")
    x = F.col("fp").bitwiseXOR(F.col("ifp"))
    first = F.coalesce(*[F.when(F.bit_count(_block(x, b)) <= RADIUS // BLOCKS, F.lit(b)) for b in range(BLOCKS)])
    near = keyed.join(index, ["n", "b", "v"]).where((F.bit_count(x) <= RADIUS) & (first == F.col("b"))).select(*keys, "item_id")
    # The radius suits windows of as many distinct shingles as their item. Where shingles repeat, or a document is shorter than the
    # item, bits lie further apart at the same similarity, so those meet by the shingle that they share.
    plain = lambda sh: F.size(F.array_distinct(sh)) == F.size(sh)
    odd = ~plain("sh") | (F.size("sh") < F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1)
    spread = windows.select(*keys, odd.alias("odd"), F.explode(F.array_distinct("sh")).alias("h"))
    by_shingle = items.select("item_id", F.col("n"), (~plain("ish")).alias("i_odd"), F.explode(F.array_distinct("ish")).alias("h"))
    met = spread.join(by_shingle, ["n", "h"]).where(F.col("odd") | F.col("i_odd")).select(*keys, "item_id")
    pairs = near.union(met).distinct()
    pairs = pairs.select(*[F.col(c).alias(f"p_{c}") for c in keys], F.col("item_id").alias("p_item"))
    told = windows.join(pairs, windows["doc_id"].eqNullSafe(F.col("p_doc_id")) & (windows["th"] == F.col("p_th"))
                        & (windows["n"] == F.col("p_n")) & (windows["s"] == F.col("p_s")))
    exact = items.select("item_id", F.col("n").alias("i_n"), "ish")
    told = told.join(exact, exact["item_id"].eqNullSafe(F.col("p_item")) & (F.col("i_n") == F.col("n")))
    told = told.withColumn("common", _common_weight("sh", "ish"))
    similarity = F.col("common") / (F.size("sh") + F.size("ish") - F.col("common"))
    return told.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most_wanted: int = MOST_WANTED
) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): a row for each document and benchmark item of which the
    document holds a similar window, with its best window.

    Texts are used whole. A null or empty text, on either side, holds nothing. A document shorter than an item
    is compared whole. Rows that repeat a doc_id are told apart by their text and give one row for each
    item at most (of equally similar windows that with the least start among those that begin at a common
    shingle or end the text); null ids stay null. Empty tables give no rows; other columns are ignored.
    """
    told = _similar_windows(docs, benchmark, threshold, most_wanted)
    if told is None:
        schema = "doc_id {}, item_id {}, start int, n_words int, similarity double".format(
            docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("similarity", (-F.col("s")).alias("s"), "n"))
    return told.groupBy("doc_id", "item_id").agg(best.alias("m")).select(
        "doc_id", "item_id", (-F.col("m.s")).alias("start"), F.col("m.n").alias("n_words"), "m.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no similar window of any benchmark item. Rows are told apart by doc_id and the text's hash, so
    a contaminated row takes no other text with it, whether they share a doc_id or have none; rows that repeat each other go or
    stay together. Null and empty texts stay. An empty table gives no rows; columns may have any name."""
    told = _similar_windows(docs, benchmark, THRESHOLD, MOST_WANTED)
    if told is None:
        return docs
    bad, th = fresh(docs, "bad"), fresh(docs, "bad_th")
    found = materialize(told.select(F.col("doc_id").alias(bad), F.col("th").alias(th)).distinct(), "bad")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(bad)) & (F.xxhash64(docs["text"]) == F.col(th)), "left_anti")


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, list_aggregate(w[p:p + k - 1], 'string_agg', ' ') AS h FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)),
dsh AS (
  SELECT doc_id, k, len(w) AS total, p - 1 AS pos, list_aggregate(w[p:p + k - 1], 'string_agg', ' ') AS h
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
hit AS (SELECT DISTINCT doc_id, pos, total, item_id, n, k, h FROM dsh JOIN ish USING (k, h)),
win AS (SELECT DISTINCT doc_id, item_id, n, k, total, least(pos, greatest(total - n, 0)) AS s FROM hit),
cnt AS (
  SELECT win.doc_id, win.item_id, win.n, win.k, win.total, s, h, count(*) AS c FROM win JOIN hit
  ON win.doc_id = hit.doc_id AND win.item_id = hit.item_id AND pos >= s AND pos <= s + win.n - win.k GROUP BY ALL),
icnt AS (SELECT item_id, h, count(*) AS c FROM ish GROUP BY ALL),
sims AS (
  SELECT doc_id, item_id, s, n, SUM(least(cnt.c, icnt.c))::DOUBLE AS common, any_value(least(n, total) - k + 1 + n - k + 1) AS weight
  FROM cnt JOIN icnt USING (item_id, h) GROUP BY ALL),
best AS (
  SELECT doc_id, item_id, s, n, common / (weight - common) AS similarity FROM sims WHERE common / (weight - common) >= 0.8
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1)
SELECT doc_id, item_id, s::INT AS start, n::INT AS n_words, similarity FROM best
"""
