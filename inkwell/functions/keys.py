"""Keys, variants and strata of short notes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as T

# How a span's numbers are classed, and the slang units of an amount.
_SHAPES = ((r"\d{1,3}(?:\.\d{3})+(?!\d)", "<dot3>"), (r"\d{1,3}(?:,\d{3})+(?!\d)", "<com3>"), (r"\d+\.\d+", "<dec.>"), (r"\d+,\d+", "<dec,>"), (r"(?<![\d<])\d{5,}", "<long>"), (r"\d+(?!\d*>)", "<num>"))
SLANG = ("cu", "xi", "lit", "chai", "canh", "toi")


def skeleton(x: Column, start: Column, end: Column) -> Column:
    """The normal form with the span [start, end) and every capitalised word beyond the first as x; null bounds mask no span."""
    masked = F.when(start.isNull(), x).otherwise(F.concat(F.substring(x, F.lit(1), start), F.lit(" x "), F.substring(x, end + 1, F.length(x))))
    return T.normalize(F.regexp_replace(masked, r"(?<=\s)\p{Lu}\p{L}*", "x"))


def fold_keep_case(x: Column) -> Column:
    """Without accents, d for a d with stroke, case kept."""
    return F.translate(T.strip_accents(x), "đĐ", "dD")


def masked_template(x: Column, start: Column, end: Column) -> Column:
    """Lower case with the span as § and digits as #."""
    masked = F.when(start.isNull(), x).otherwise(F.concat(F.substring(x, F.lit(1), start), F.lit("§"), F.substring(x, end + 1, F.length(x))))
    return F.regexp_replace(F.lower(masked), r"\d", "#")


def pattern_signature(x: Column) -> Column:
    """The shape of an amount: ``50k`` as ``<num>k``, ``1.5tr`` as ``<dec.>tr``, ``80.000đ`` as ``<dot3>đ``; letters but for đ without accents, case and spaces kept."""
    out = T.strip_accents(x)
    for pattern, name in _SHAPES:
        out = F.regexp_replace(out, pattern, name)
    return out


def slang_unit(x: Column) -> Column:
    """The first slang unit among a span's words, or null."""
    words = F.regexp_extract_all(T.fold(x), F.lit(r"[\p{L}]+"), 0)
    found = F.filter(words, lambda w: w.isin(*SLANG))
    return F.get(found, F.lit(0))


def variants(x: Column, start: Column, end: Column) -> dict[str, Column]:
    """Ways to write a note otherwise: its span in lower case, all without accents, both, numbers glued to their unit, accents off the span alone."""
    head, span, tail = F.substring(x, F.lit(1), start), F.substring(x, start + 1, end - start), F.substring(x, end + 1, F.length(x))
    return {
        "lower_span": F.concat(head, F.lower(span), tail), "plain": fold_keep_case(x), "plain_lower": F.lower(fold_keep_case(x)),
        "glued": F.regexp_replace(x, r"(?<=\d) (?=(?:tr|triệu|k|nghìn|ngàn|củ|tỷ)\b)", ""), "plain_span": F.concat(head, fold_keep_case(span), tail)}


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template with {{name}} places filled; a place that no value names stays."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value.cast("string"))
    return template


def number_roles(x: Column) -> Column:
    """(text, role) of each number of a note in order: time, date, percent, phone, ordinal, money, measure, year, or plain."""
    found = F.regexp_extract_all(x, F.lit(r"(?:[$€£]\s?)?\d[\d.,:/]*\d\s?(?:%|€|\p{L}{1,4}\b)?|(?:[$€£]\s?)?\d\s?(?:%|€|\p{L}{1,4}\b)?"), 0)

    def role(m: Column) -> Column:
        return (
            F.when(m.rlike(r"\d:\d"), "time").when(m.rlike(r"\d/\d"), "date").when(m.rlike("%"), "percent").when(m.rlike(r"\A0\d{8,10}\b"), "phone")
            .when(m.rlike(r"(?i)\d(?:st|nd|rd|th)\b"), "ordinal").when(m.rlike(r"(?i)[$€£]|\d\s?(?:usd|eur|k)\b"), "money")
            .when(m.rlike(r"(?i)\d\s?(?:kg|g|km|m|cm|ml|l|gb|mb)\b"), "measure").when(m.rlike(r"\A(?:19|20)\d\d\b"), "year").otherwise("plain"))

    return F.transform(found, lambda m: F.struct(m.alias("text"), role(m).alias("role")))
