"""Similarity of texts as sequences: twice the characters in common blocks over all characters, and the ordered rules that join near copies.

There is no exact index for it, so it is for a bounded set of queries against all rows. Before the exact ratio, which runs in Arrow batches, the
JVM drops pairs that cannot reach the threshold: by length, then by how many characters of each kind they share. Both bounds are those
of the ratio itself, so nothing is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from inkwell.functions import text as T
from inkwell.operators.similar import once

_KINDS = "abcdefghijklmnopqrstuvwxyz0123456789 "
SEQUENCE, TOKENS, LEAST_TOKENS, CHAR3 = 0.90, 0.80, 3, 0.80


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two texts; blocks are found from the first text's side."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _counts(x: Column) -> Column:
    """How often each of the usual characters occurs, and how many others there are."""
    usual = [F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) for c in _KINDS]
    return F.array(*usual, F.length(F.translate(x, _KINDS, "")))


def sequence_pairs(queries: DataFrame, refs: DataFrame, threshold: float, most: int = 10_000) -> DataFrame:
    """(q, r, ratio) of each query (q, qx) and row (r, rx) whose ratio is at least ``threshold``. ``queries`` is a stated set of ``most`` rows at most (more raise an
    error), so it is broadcast; copies among ``refs`` count once and the least r stands for them; two empty texts have ratio 1."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries")
    left = F.broadcast(queries.select("q", "qx", F.length("qx").alias("qn"), _counts(F.col("qx")).alias("qc")))
    right = refs.groupBy("rx").agg(F.min("r").alias("r")).select("r", "rx", F.length("rx").alias("rn"), once(_counts(F.col("rx"))).alias("rc"))
    total = F.col("qn") + F.col("rn")
    near = right.join(left, F.least("qn", "rn") * 2 >= total * threshold - 1e-9)
    shared = F.aggregate(F.zip_with("qc", "rc", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = near.where(shared * 2 >= total * threshold - 1e-9)
    return near.select("q", "r", ratio("qx", "rx").alias("ratio")).where(F.col("ratio") >= threshold)


def nearest(queries: DataFrame, refs: DataFrame, floor: float = 0.5) -> DataFrame:
    """(q, r, ratio): each query's row of greatest ratio, the least r among equals, if it reaches ``floor``."""
    best = F.min(F.struct((-F.col("ratio")).alias("m"), "r"))
    return sequence_pairs(queries, refs, floor).groupBy("q").agg(best.alias("b")).select("q", "b.r", (-F.col("b.m")).alias("ratio"))


def content_tokens(folded: Column) -> Column:
    """Distinct runs of two letters and more."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(r"\p{L}{2,}"), 0))


def first_rules(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(q, r, rule) of each query (q, text) and row (r, text) that a rule ties, with the first that does: exact (trimmed, lower case), folded (accents and digits aside),
    sequence (ratio of 0.90), token (content words, three on either side, Jaccard 0.80), char3 (character trigrams, Jaccard 0.80).

    Exact and folded are equi-joins; token and char3 are joins on shared elements that count them; each rule is one relation, and the least rank wins.
    """
    from inkwell.operators.similar import set_similarity_to_items

    keyed = lambda df, key: df.where("text is not null").select(F.col(key), T.exact_key(F.col("text")).alias("exact"), T.digit_mask(F.col("text")).alias("folded"))
    a, b = keyed(queries, "q"), keyed(refs, "r")
    same = lambda name, rank: a.select("q", name).join(b.select("r", name), name).select("q", "r", F.lit(rank).alias("rank"))
    sequence = sequence_pairs(a.select("q", F.col("folded").alias("qx")), b.select("r", F.col("folded").alias("rx")), SEQUENCE)
    copies = b.select("r", "folded")
    first = copies.groupBy("folded").agg(F.min("r").alias("first"))
    sequence = sequence.join(copies.join(first, "folded").select(F.col("first").alias("r"), F.col("r").alias("each")), "r").select("q", F.col("each").alias("r"), F.lit(2).alias("rank"))

    def by_sets(make, threshold: float, rank: int, least: int) -> DataFrame:
        docs = b.select(F.col("r").alias("id"), F.xxhash64("folded").alias("th"), once(make(F.col("folded"))).alias("tokens")).where(F.size("tokens") >= least)
        items = a.select(F.col("q").alias("item_id"), once(make(F.col("folded"))).alias("tokens")).where(F.size("tokens") >= least)
        return set_similarity_to_items(docs, items, threshold).select(F.col("item_id").alias("q"), F.col("id").alias("r"), F.lit(rank).alias("rank"))

    whole = same("exact", 0).union(same("folded", 1)).union(sequence).union(by_sets(content_tokens, TOKENS, 3, LEAST_TOKENS)).union(by_sets(T.char3, CHAR3, 4, 1))
    names = F.array(*map(F.lit, ("exact", "folded", "sequence", "token", "char3")))
    return whole.groupBy("q", "r").agg(F.min("rank").alias("rank")).select("q", "r", F.get(names, F.col("rank")).alias("rule"))
