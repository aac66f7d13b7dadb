"""Text keys as column expressions: folding, normal forms, bags, shingles, hashes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry nothing for a bag key, and how amounts look in folded text.
STOPWORDS = ("cho", "minh", "tao", "toi", "lai", "roi", "nha", "ok", "da", "dc", "duoc")
AMOUNT = r"\b\d[\d.,]*\s*(k|tr\d*|trieu|nghin|cu|d|%)?(?=\W|$)"


def _accents() -> tuple[str, str]:
    """Letters below U+2000 that decompose into one base letter and marks, and their bases."""
    pairs = []
    for code in range(0xA0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code) and unicodedata.category(chr(code))[0] == "L":
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip_accents(x: Column) -> Column:
    """Base letters for accented ones, case kept; the stroke of d is no accent and stays."""
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"\p{Mn}", "")


def fold(x: Column) -> Column:
    """Lower case without accents, d for a d with stroke."""
    return F.replace(strip_accents(F.lower(x)), F.lit("đ"), F.lit("d"))


def squeeze(x: Column) -> Column:
    """Runs of white space become one space; none at the edges."""
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def normalize(x: Column) -> Column:
    """Folded text with amounts masked as N, without commas and full stops."""
    return squeeze(F.regexp_replace(F.regexp_replace(fold(x), AMOUNT, " N "), "[,.]", " "))


def bag_key(normal: Column) -> Column:
    """The sorted words of a normal form without stopwords, as one string."""
    return F.array_join(F.sort_array(F.filter(F.split(normal, " "), lambda w: ~w.isin(*STOPWORDS) & (w != ""))), " ")


def template_key(x: Column, start: Column, end: Column) -> Column:
    """The normal form with the code points [start, end) masked; unmasked where start is null."""
    masked = F.concat(F.substring(x, F.lit(1), start), F.lit(" § "), F.substring(x, end + 1, F.length(x)))
    return normalize(F.when(start.isNull(), x).otherwise(masked))


def accented(x: Column) -> Column:
    return x.rlike(r"[^\x00-\x7F]")


def surface_pattern(x: Column) -> Column:
    """Lower case, digit runs as n, single spaces."""
    return squeeze(F.regexp_replace(F.lower(x), r"\d+", "n"))


def digit_mask(x: Column) -> Column:
    """Folded with every digit as #."""
    return F.regexp_replace(fold(x), r"\d", "#")


def exact_key(x: Column) -> Column:
    return F.lower(F.btrim(x))


def char3(x: Column) -> Column:
    """Distinct character trigrams of the text with a space at either edge."""
    chars = F.split(F.concat(F.lit(" "), x, F.lit(" ")), "")  # by place an array is read in no time, a string is not
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    grams = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: F.concat(F.get(c, i), at(c, i + 1), at(c, i + 2)))
    return F.array_distinct(F.get(F.transform(F.array(chars), grams), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays of distinct elements; 0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def seeded_hash(seed: str, *parts: Column) -> Column:
    """sha256 of the seed and the parts joined by colons, in hex: an order that depends on nothing else."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def words(x: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def preview(x: Column, most: int = 40) -> Column:
    flat = squeeze(x)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def redact_url(x: Column) -> Column:
    """Query and fragment cut off."""
    return F.regexp_replace(x, r"[?#].*$", "")


def event_fingerprint(*parts: Column) -> Column:
    """Parts joined by |, long hex and digit runs folded, 120 characters."""
    joined = F.concat_ws("|", *parts)
    return F.substring(F.regexp_replace(F.regexp_replace(joined, r"\b[0-9a-f]{8,}\b", "h"), r"\d+", "n"), 1, 120)
