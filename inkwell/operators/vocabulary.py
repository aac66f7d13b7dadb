"""Vocabularies of byte-level BPE files as tables: tokens, merges, closures, categories, pruning and greedy pieces."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from inkwell.session import materialize


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes: visible Latin-1 characters for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(spare)): b for b in range(256)}


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, token, special) and (rank, a, b, made) of a vocabulary file; ids of the merged parts and of what they make. One file of some
    megabytes, read where the plan is made."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["content"] for t in told["added_tokens"]}
    vocab = told["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    tokens = pd.DataFrame([(i, t, t in special) for t, i in vocab.items()], columns=["id", "token", "special"])
    merges = pd.DataFrame([(r, vocab[a], vocab[b], vocab[a + b]) for r, (a, b) in enumerate(pairs)], columns=["rank", "a", "b", "made"])
    return materialize(spark.createDataFrame(tokens), "tokens"), materialize(spark.createDataFrame(merges), "merges")


def token_hex(token: Column) -> Column:
    """The bytes of a token of the byte alphabet, in hex; null where a character is not of the alphabet."""
    pairs = [x for c, b in byte_alphabet().items() for x in (F.lit(c), F.lit(f"{b:02X}"))]
    table = F.create_map(*pairs)
    parts = F.transform(F.split(token, ""), lambda c: F.try_element_at(table, c))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def token_text(token: Column) -> Column:
    """The text of a token; null where its bytes are only a part of a character."""
    return F.try_validate_utf8(F.unhex(token_hex(token)).cast("string"))


def category(text: Column, special: Column, base: Column) -> Column:
    """Of what a token is made, the first that holds: special, one byte of the alphabet, a part of a character, other scripts, digits, Latin letters with marks, other symbols,
    letters, letters with punctuation, punctuation."""
    return (
        F.when(special, "special").when(base, "base_byte").when(text.isNull(), "partial_byte").when(text.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), "non_latin_script")
        .when(text.rlike(r"[0-9]"), "digits_numeric").when(text.rlike(r"[\p{IsLatin}&&[^\x00-\x7F]]"), "marked_latin").when(text.rlike(r"[^\x00-\x7F]"), "other_symbols")
        .when(text.rlike(r"\A *[A-Za-z]+\z"), "ascii_letters").when(text.rlike("[A-Za-z]"), "ascii_letters_with_punct").otherwise("ascii_punct_symbols"))


def closure(kept: DataFrame, merges: DataFrame) -> DataFrame:
    """(id): the kept ids and all that their merges are made of, by rounds until nothing is new; rounds are bounded by the longest token."""
    ids = materialize(kept.select("id").distinct(), "closure")
    fresh = ids
    while not fresh.isEmpty():
        parts = merges.join(fresh, merges["made"] == fresh["id"]).select(F.explode(F.array("a", "b")).alias("id")).distinct()
        fresh = materialize(parts.join(ids, "id", "left_anti"), "fresh")
        ids = materialize(ids.union(fresh), "closure")
    return ids


def prune(tokens: DataFrame, merges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens (new_id, id, token) and merges (new_rank, rank) of which all parts are kept, numbered anew without gaps in the old order."""
    from inkwell.operators.ranks import number_rows

    named = number_rows(tokens.join(kept, "id", "left_semi"), "id", name="new_id").select("new_id", "id", "token")
    whole = merges
    for part in ("a", "b", "made"):
        whole = whole.join(kept.select(F.col("id").alias(part)), part, "left_semi")
    return named, number_rows(whole.select("rank"), "rank", name="new_rank")


def greedy_pieces(words: Column, pieces: frozenset[str], prefix: str = "##", unknown: str = "[UNK]", most: int = 100) -> Column:
    """The longest pieces from the left of each word; pieces within a word have a prefix; a word with no way to cover it, or too long, is unknown.
    For distinct words: the vocabulary travels with the function."""
    longest = max((len(p) for p in pieces), default=1)

    def cut(word: str) -> list[str]:
        out, at = [], 0
        if len(word) > most:
            return [unknown]
        while at < len(word):
            head = prefix if at else ""
            end = next((e for e in range(min(len(word), at + longest), at, -1) if head + word[at:e] in pieces), None)
            if end is None:
                return [unknown]
            out.append(head + word[at:end])
            at = end
        return out

    @pandas_udf(ArrayType(StringType()))
    def run(column: pd.Series) -> pd.Series:
        return column.map(cut, na_action="ignore")

    return run(words)


def layer_map(source: int, kept: int) -> list[int]:
    """Which of ``source`` layers the ``kept`` ones come from: evenly spread, first and last included."""
    return [i * (source - 1) // (kept - 1) for i in range(kept)] if kept > 1 else [0]


def top_ascending(scores: Column, k: int) -> Column:
    """Places of the k largest scores, of equals the lower places, in ascending order."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["i"]))
