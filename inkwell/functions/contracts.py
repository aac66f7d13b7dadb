"""Contracts of labels, proposals and merged records, as columns that list the broken rules in fixed order.

A record is a set of columns and ``keys``, the names of the fields that it has; a field that is there may be null. A span is three columns:
its text, start and end, and a column that says whether there is a span. Rules compare null-safely, so no rule yields null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.spans import slice_of
from inkwell.functions.text import fold
from inkwell.sources.ingest import nfc

EDGE = " \t\n\x0b\x0c\r"
# What a span of an amount ought not to hold.
PER_UNIT = r"/\s?(thang|tuan|ngay|nam|lan|nguoi)"
APPROXIMATORS = r"^(tam|khoang|hon|gan|ngot|chung|~)"
PERIODS = r"(thang|quy|ky|tuan|ngay)\s?\d"
NUMBER_WORDS = r"\b(mot|hai|ba|bon|tu|nam|sau|bay|tam|chin|muoi|tram|chuc|nua)\b"


@dataclass(frozen=True)
class Rules:
    """What a contract allows."""

    types: Sequence[str]
    statuses: Sequence[str]
    required: Sequence[str]
    optional: Sequence[str] = ()
    null_target_types: Sequence[str] = ()
    null_label_statuses: Sequence[str] = ()
    note_statuses: Sequence[str] = ()
    trainable: Sequence[str] = ("complete",)
    provenances: Sequence[str] = ("human", "rule")


@dataclass(frozen=True)
class Span:
    text: Column
    start: Column
    end: Column
    there: Column


def span_of(prefix: str) -> Span:
    """The columns PREFIX_text, PREFIX_start and PREFIX_end; a span is there unless all are null."""
    text, start, end = (F.col(f"{prefix}_{x}") for x in ("text", "start", "end"))
    return Span(text, start, end, text.isNotNull() | start.isNotNull() | end.isNotNull())


def broken(*rules: tuple[Column, Column | str]) -> Column:
    """The names of the rules whose condition is true; a null condition counts as not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for test, name in rules]))


def blank(x: Column) -> Column:
    return x.isNull() | (F.btrim(x, F.lit(EDGE)) == "")


def fields(keys: Column, rules: Rules) -> Column:
    """Missing and unknown fields."""
    names = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    missing = F.transform(F.array_except(names(list(rules.required)), keys), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.array_except(keys, names([*rules.required, *rules.optional])), lambda k: F.concat(F.lit("unknown "), k))
    return F.concat(missing, F.array_sort(unknown))


def span_mechanics(span: Span, text: Column, name: str) -> Column:
    """Broken rules of a span that is there: first those of its parts; bounds and equality with the text only if all parts are right,
    and only the first of these. A null text leaves bounds open."""
    x, s, e = span.text, span.start, span.end
    parts = broken(
        (blank(x) & (F.coalesce(x, F.lit("")) == ""), f"{name}.text: empty"),
        ((x != "") & (x != F.btrim(x, F.lit(EDGE))), f"{name}.text: edges"),
        ((x != "") & (x == F.btrim(x, F.lit(EDGE))) & (x != nfc(x)), f"{name}.text: not NFC"),
        (s.isNull() | (s < 0), f"{name}.start: not a position"), (e.isNull() | (e < 0), f"{name}.end: not a position"))
    whole = F.when(s >= e, f"{name}: start not before end").when(e > F.length(text), f"{name}: beyond the text").when(
        slice_of(text, s, e) != x, f"{name}: text differs")
    return F.when(~span.there, F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array_compact(F.array(whole)))


def _head(rules: Rules, keys: Column, target: Span) -> Column:
    """Rules that labels of all kinds share, up to their type."""
    ident, note, status, kind = (F.col(x) for x in ("id", "note", "annotation_status", "type"))
    no_label = F.coalesce(status.isin(*rules.null_label_statuses), F.lit(False)) if rules.null_label_statuses else F.lit(False)
    needs_note = status.isin(*rules.note_statuses) if rules.note_statuses else F.lit(False)
    return broken(
        (F.array_contains(keys, "id") & (F.coalesce(ident, F.lit("")) == ""), "id: empty"),
        (F.array_contains(keys, "annotation_status") & ~F.coalesce(status.isin(*rules.statuses), F.lit(False)), "annotation_status: not declared"),
        (needs_note & blank(note), "note: required"),
        (no_label & kind.isNotNull(), "type: must be null"), (no_label & target.there, "target: must be null"),
        (kind.isNull() & (status == "complete"), "type: required"), (kind.isNotNull() & ~kind.isin(*rules.types), "type: not declared"))


def label(rules: Rules, text: Column, target_required: bool = False, rule_made: bool = False) -> Column:
    """Broken rules of a label with a target. ``target_required``: a complete label of a type that may have a target needs one.
    ``rule_made``: its provenance must be rule."""
    keys, target, kind, status = F.col("keys"), span_of("target"), F.col("type"), F.col("annotation_status")
    null_type = kind.isin(*rules.null_target_types) if rules.null_target_types else F.lit(False)
    rest = [(target.there & null_type, "target: must be null for the type")]
    if target_required:
        rest.append((~target.there & (status == "complete") & kind.isNotNull() & ~null_type, "target: required"))
    if rule_made:
        rest.append((~F.col("provenance").eqNullSafe("rule"), "provenance: not rule"))
    return F.concat(fields(keys, rules), _head(rules, keys, target), span_mechanics(target, text, "target"), broken(*rest))


def combined(rules: Rules, text: Column, value_statuses: Sequence[str], value_null_types: Sequence[str]) -> Column:
    """Broken rules of a label with a target, a value and, where it is there, the value's status."""
    keys, value, kind, status = F.col("keys"), span_of("value"), F.col("type"), F.col("annotation_status")
    no_label = F.coalesce(status.isin(*rules.null_label_statuses), F.lit(False)) if rules.null_label_statuses else F.lit(False)
    told, its = F.array_contains(keys, "span_status"), F.col("value_status")
    return F.concat(
        label(rules, text), span_mechanics(value, text, "value"),
        broken((value.there & kind.isin(*value_null_types), "value: must be null for the type"), (no_label & value.there, "value: must be null"),
               (told & no_label, "span_status: must be absent"),
               (told & ~no_label & ~F.coalesce(its.isin(*value_statuses), F.lit(False)), "span_status.value: not declared"),
               (told & ~no_label & its.isin(*[s for s in rules.note_statuses if s in value_statuses]) & blank(F.col("note")), "note: required by span_status")))


def proposal(rules: Rules, text: Column) -> Column:
    """Broken rules of a proposal: a label's, but for fields, with a confidence from 0 to 1."""
    status, kind, target, sure = F.col("annotation_status"), F.col("type"), span_of("target"), F.col("confidence")
    null_type = kind.isin(*rules.null_target_types) if rules.null_target_types else F.lit(False)
    return F.concat(
        broken((F.coalesce(F.col("id"), F.lit("")) == "", "id: empty"), (status.isNull(), "annotation_status: missing"),
               (status.isNotNull() & ~status.isin(*rules.statuses), "annotation_status: not declared"),
               (kind.isNotNull() & ~kind.isin(*rules.types), "type: not declared"), (kind.isNull() & (status == "complete"), "type: required")),
        span_mechanics(target, text, "target"),
        broken((target.there & null_type, "target: must be null for the type"), (~sure.between(0, 1) | F.isnan(sure), "confidence: not from 0 to 1"),
               ((status.isin(*rules.note_statuses) if rules.note_statuses else F.lit(False)) & blank(F.col("note")), "note: required")))


def merged(rules: Rules, text: Column) -> Column:
    """Broken rules of a training record with a target and a value. The two may not overlap; that is asked of a right value only."""
    value, target = span_of("value"), span_of("target")
    need = ("id", "text", "type", "target", "value", "value_status", "value_provenance")
    missing = F.transform(F.array_except(F.array(*map(F.lit, need)), F.col("keys")), lambda k: F.concat(F.lit("missing "), k))
    first = F.concat(
        broken((text.isNull() | (text != nfc(text)), "text: not NFC"),
               (~F.coalesce(F.col("value_status").isin("complete", "uncertain"), F.lit(False)), "value_status: not declared"),
               (~F.coalesce(F.col("value_provenance").isin(*rules.provenances), F.lit(False)), "value_provenance: not declared")),
        span_mechanics(value, text, "value"),
        broken((value.there & ~F.col("value_status").eqNullSafe("complete"), "value: must be null")))
    meets = value.there & target.there & (value.start < target.end) & (target.start < value.end)
    overlap = F.when((F.size(first) == 0) & F.coalesce(meets, F.lit(False)), F.array(F.lit("value: overlaps the target"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(missing) > 0, missing).otherwise(F.concat(first, overlap))


def value_record(rules: Rules, text: Column) -> Column:
    """The first broken rule of a record that a value model trains on, or null."""
    value, keys = span_of("value"), F.col("keys")
    lacks = F.array_except(F.array(*map(F.lit, ("value", "value_status", "value_provenance"))), keys)
    return (
        F.when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.get(lacks, F.lit(0))))
        .when(~F.coalesce(F.col("value_status").isin("complete", "uncertain"), F.lit(False)), "value_status")
        .when(~F.coalesce(F.col("value_provenance").isin(*rules.provenances), F.lit(False)), "value_provenance")
        .when(value.there & ~F.coalesce((value.start >= 0) & (value.start < value.end) & (value.end <= F.length(text)), F.lit(False)), "offsets")
        .when(value.there & ~F.coalesce(slice_of(text, value.start, value.end) == value.text, F.lit(False)), "text differs")
        .when(value.there & (value.text != F.btrim(value.text, F.lit(EDGE))), "edges"))


def exact_record(keys: Sequence[str], types: Sequence[str], annotator: str, text: Column) -> Column:
    """The first broken rule of a record that must have exactly these fields, a declared type, one annotator and a target that is its
    slice of the text; or null."""
    target = span_of("target")
    return (
        F.when(F.array_sort("keys") != F.array_sort(F.array(*map(F.lit, keys))), "keys")
        .when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "type")
        .when(~F.col("annotator").eqNullSafe(annotator), "annotator")
        .when(target.there & ~F.coalesce(slice_of(text, target.start, target.end) == target.text, F.lit(False)), "target"))


def span_warnings(span_text: Column) -> Column:
    """Soft findings on the text of an amount's span."""
    folded = fold(span_text)
    return broken(
        (~span_text.rlike(r"\d") & ~folded.rlike(NUMBER_WORDS), "no number"), (folded.rlike(PER_UNIT), "per unit"),
        (folded.rlike(APPROXIMATORS), "approximate"), (folded.rlike(PERIODS), "period"))
