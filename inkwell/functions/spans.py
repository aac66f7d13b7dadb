"""Span algebra over code points: start inclusive, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Number of shared code points."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def outcome(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """exact, correct_null, false, missed, partial or disjoint."""
    return (
        F.when(gs.isNull() & ps.isNull(), "correct_null").when(gs.isNull(), "false").when(ps.isNull(), "missed")
        .when((gs == ps) & (ge == pe), "exact").when(overlap(gs, ge, ps, pe) > 0, "partial").otherwise("disjoint"))


def error_class(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """How a predicted interval lies to the gold one."""
    return (
        F.when(gs.isNull() & ps.isNull(), "none").when(gs.isNull(), "spurious").when(ps.isNull(), "missing")
        .when((gs == ps) & (ge == pe), "exact")
        .when((ps <= gs) & (pe >= ge), "too_long").when((ps >= gs) & (pe <= ge), "too_short")
        .when((ps < gs) & (pe > gs), "shifted_left").when((ps < ge) & (pe > ge), "shifted_right").otherwise("elsewhere"))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def violations(text: Column, span: Column, start: Column, end: Column) -> Column:
    """Names of the broken rules of a span, in fixed order."""
    return F.array_compact(F.array(
        F.when(start.isNull() != end.isNull(), "half_open"), F.when(span == "", "empty"), F.when(span != F.btrim(span), "not_trimmed"),
        F.when((start < 0) | (end > F.length(text)) | (start >= end), "out_of_bounds"),
        F.when(slice_of(text, start, end) != span, "text_differs")))


def snap_to_words(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end moved outwards to the edges of the words that they cut."""
    before = F.regexp_extract(F.substring(text, F.lit(1), start), r"(\S*)\z", 1)
    after = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^(\S*)", 1)
    return start - F.length(before), end + F.length(after)


def occurrences(text: Column, word: Column) -> Column:
    """All starts of a word in a text, overlapping ones included, in order; an empty array for an empty word. The pieces between matches of a
    lookahead that consumes one character add up to the starts, so the work is one pass over the text."""
    pattern = F.concat(F.lit("(?s)(?=\\Q"), word, F.lit("\\E)."))
    pieces = F.split(text, pattern)
    found = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, piece: F.struct((s["at"] + F.length(piece) + 1).alias("at"), F.array_append(s["starts"], s["at"] + F.length(piece)).alias("starts")))
    return F.when((word == "") | ~F.contains(text, word), F.array().cast("array<int>")).otherwise(found["starts"])
