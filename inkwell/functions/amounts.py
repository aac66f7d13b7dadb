"""Amounts of money in short notes, as column expressions.

Everything is a regular expression, a lookup in a literal map and arithmetic, so notes are read inside the JVM.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.numerals import english_number
from inkwell.functions.text import fold, squeeze

# Units and their worth, and how amounts are written.
ENGLISH_SCALE = {"k": 1e3, "m": 1e6, "mil": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "grand": 1e3}
VND_UNITS = {
    "k": 1e3, "ng": 1e3, "nghin": 1e3, "ngan": 1e3, "tr": 1e6, "trieu": 1e6, "cu": 1e6, "ty": 1e9,
    "xi": 1e5, "lit": 1e5, "canh": 1e5, "chai": 1e6, "toi": 1e9,
}
ENGLISH_NUMBER = (
    r"(?i)(?<![\p{L}\p{N}.,/:$])\$?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:k|m|b|bn|\s?(?:mil|million|billion|grand))?"
    r"(?:\s?(?:bucks?|dollars?|usd))?(?![\p{L}\p{N}]|[/:]\d)"
)
MONEY_WORD = r"(?i)\s?(?:bucks?|dollars?|usd)$"
ENGLISH_AMOUNT = r"(?i)^\$?(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?\s?([a-z]*)$"
VND_AMOUNT = r"^(\d{1,3}(?: \d{3}){2,}|\d+(?:[.,]\d+)*) ?([a-z]*?) ?(?:(ruoi)|(\d+) ?([a-z]*))?$"
SAFE = float(2**53 - 1)


def _lookup(values: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def amount_from_english(x: Column) -> Column:
    """``2.5k``, ``$1,200``, ``3 million`` as a number rounded to cents; null for anything else."""
    t = F.btrim(x)
    part = lambda i: F.regexp_extract(t, ENGLISH_AMOUNT, i)
    scale = F.when(part(3) == "", F.lit(1.0)).otherwise(_lookup(ENGLISH_SCALE, F.lower(part(3))))
    value = F.round(F.concat(F.regexp_replace(part(1), ",", ""), part(2)).try_cast("double") * scale, 2)
    return F.when(t.rlike(ENGLISH_AMOUNT) & (value <= SAFE), value)


def find_english_value(note: Column) -> Column:
    """The text of a note's amount without currency marks: the last number with a mark ($ or a money word), or else the last number; null if there
    is none."""
    found = F.regexp_extract_all(note, F.lit(ENGLISH_NUMBER), 0)
    marked = F.filter(found, lambda m: m.startswith("$") | m.rlike(MONEY_WORD))
    best = F.try_element_at(F.when(F.size(marked) > 0, marked).otherwise(found), F.lit(-1))
    return F.regexp_replace(F.regexp_replace(best, r"^\$", ""), MONEY_WORD, "")


def _number(text: Column, has_unit: Column) -> Column:
    """Thousands groups by point, comma or space; with a unit, one other separator is a decimal point."""
    flat = F.regexp_replace(text, " ", "")
    grouped = flat.rlike(r"^(?!0+[.,])\d{1,3}(?:[.,]\d{3})+$")
    decimal = has_unit & flat.rlike(r"^\d+[.,]\d+$")
    return (
        F.when(flat.rlike(r"^\d+$"), flat.try_cast("double")).when(grouped, F.regexp_replace(flat, "[.,]", "").try_cast("double"))
        .when(decimal, F.translate(flat, ",", ".").try_cast("double")))


def amount_to_vnd(x: Column) -> Column:
    """A written amount in digits as whole dong: ``1tr5``, ``2 cu ruoi``, ``1.200.000d``, ``1tr500k``; below 1,000 without unit or currency it counts in thousands. Null for other currencies and words."""
    folded = squeeze(fold(x))
    text = F.regexp_replace(folded, r" ?(?:₫|vnd|dong|d)$", "")
    part = lambda i: F.regexp_extract(text, VND_AMOUNT, i)
    unit, half, tail, tail_unit = part(2), part(3), part(4), part(5)
    worth = _lookup(VND_UNITS, unit)
    lead = _number(part(1), unit != "")
    more = (
        F.when(half != "", worth / 2).when(tail == "", F.lit(0.0))
        .when(tail_unit != "", tail.try_cast("double") * F.when(_lookup(VND_UNITS, tail_unit) < worth, _lookup(VND_UNITS, tail_unit)))
        .otherwise(tail.try_cast("double") * worth / F.pow(F.lit(10.0), F.length(tail))))
    value = F.when(unit == "", F.when((half == "") & (tail == ""), lead)).otherwise(lead * worth + more)
    value = F.when((text == folded) & (value < 1000), value * 1000).otherwise(value)
    readable = text.rlike(VND_AMOUNT) & ~folded.contains("$") & ~folded.contains("usd") & (value <= SAFE)
    return F.when(readable, F.round(value).cast("long"))


def format_vnd(x: Column) -> Column:
    """1200000 as ``1.200.000 ₫``."""
    return F.concat(F.translate(F.format_number(x, 0), ",", "."), F.lit(" ₫"))


def _tenth(x: Column) -> Column:
    """Rounded half up to one decimal, without a trailing zero."""
    return F.regexp_replace(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10), r"\.0\z", "")


def format_vnd_compact(x: Column) -> Column:
    """``500k``, ``1,2tr``, ``1,5 tỷ``: one decimal, the next unit where rounding reaches a thousand; whole numbers below one."""
    n = F.floor(x + 0.5)
    size = F.abs(n).cast("double")
    sign = F.when(n < 0, "-").otherwise("")
    rounded = lambda unit: F.floor(size / unit * 10 + 0.5) / 10
    billions = rounded(1e9)
    whole = F.translate(F.format_number(F.floor(billions), 0), ",", ".")
    decimal = F.regexp_replace(F.regexp_extract(F.format_string("%.1f", billions), r"(\.\d)\z", 1), r"\.", ",")
    return F.concat(sign, (
        F.when(size < 1e3, F.format_string("%.0f", size)).when((size < 1e6) & (rounded(1e3) < 1000), F.concat(F.translate(_tenth(size / 1e3), ".", ","), F.lit("k")))
        .when((size < 1e9) & (rounded(1e6) < 1000), F.concat(F.translate(_tenth(size / 1e6), ".", ","), F.lit("tr")))
        .otherwise(F.concat(whole, F.when(decimal == ",0", "").otherwise(decimal), F.lit(" tỷ")))))


def format_usd_compact(x: Column) -> Column:
    """``$950``, ``$12.50``, ``$1.2k``, ``$15M``, ``$1.5B``: cents below a thousand, else one decimal, the next unit where rounding reaches a thousand."""
    size, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    rounded = lambda unit: F.floor(size / unit * 10 + 0.5) / 10
    return F.concat(sign, F.lit("$"), (
        F.when(size < 1e3, F.regexp_replace(F.format_string("%.2f", F.floor(size * 100 + 0.5) / 100), r"\.00\z", ""))
        .when((size < 1e6) & (rounded(1e3) < 1000), F.concat(_tenth(size / 1e3), F.lit("k")))
        .when((size < 1e9) & (rounded(1e6) < 1000), F.concat(_tenth(size / 1e6), F.lit("M"))).otherwise(F.concat(_tenth(size / 1e9), F.lit("B")))))


# Currency marks of English spans.
_MARKS = r"(?<=\d)\s?(?:us|s|a|c)?\$|\b(?:us|s|a|c)\$|[$£€₹¥₱]|(?<![a-z])(?:bucks?|bux|dollars?|usd|sgd|gbp|eur|inr|quid|pounds?|euros?|rupees?|rs|aed|cents?)\b"


def amount_from_english_span(x: Column) -> Column:
    """The number that a span stands for, marks included: ``$20``, ``rs 500``, ``twenty bucks``; ``50 cents`` is 0.5. Null where the rest is no amount."""
    text = F.btrim(F.lower(x))
    rest = F.btrim(F.regexp_replace(text, _MARKS, ""))
    value = F.when(rest.rlike(r"\d"), amount_from_english(rest)).otherwise(english_number(rest))
    return F.when(rest != "", F.when(text.rlike(r"(?<![a-z])cents?\b"), F.round(value) / 100).otherwise(value))


def read_english_value(span: Column, note: Column) -> Column:
    """(value, amount) of a model's span: its longest leading part, cut at spaces, that reads as an amount; else what a scan of the note finds."""
    words = F.split(F.btrim(span), " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    told = F.filter(F.transform(parts, lambda p: F.struct(p.alias("value"), amount_from_english_span(p).alias("amount"))), lambda p: p["amount"].isNotNull())
    found = find_english_value(note)
    return F.coalesce(F.get(told, F.lit(0)), F.struct(found.alias("value"), amount_from_english(found).alias("amount")))
