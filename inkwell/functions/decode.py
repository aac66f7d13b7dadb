"""Decoding of tag sequences into spans, as column expressions over the arrays of a row: nothing leaves the JVM and no row is split.

Tags are 0 outside, 1 begin, 2 inside. Logits are flat arrays, three for each token in order. Offsets are arrays of (s, e) in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import arrays as A

TAGS = 3
OUTSIDE, BEGIN, INSIDE = range(TAGS)
_SPAN = "struct<s:int,e:int,members:array<int>,total:double>"


def trim_span(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span shrunk off white space at its edges; one of white space alone becomes empty at its end."""
    piece = F.substring(text, start + 1, end - start)
    left = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
    right = F.length(piece) - F.length(F.regexp_replace(piece, r"\s+$", ""))
    blank = left == F.length(piece)
    return start + left, F.when(blank, end).otherwise(end - right)


def rows_of(flat: Column, width: int = TAGS) -> Column:
    """A flat array as an array of rows of ``width`` numbers."""
    steps = F.floor(F.size(flat) / width).cast("int")
    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda t: F.slice(flat, t * width + 1, F.lit(width)))).otherwise(
        F.array().cast("array<array<double>>"))


def argmax_tags(rows: Column, real: Column) -> Column:
    """Each token's tag of greatest logit, the first among equals; outside where the token is not ``real``."""
    return F.zip_with(rows, real, lambda r, ok: F.when(ok, A.argmax(r)).otherwise(OUTSIDE))


def tokens(text: Column, offsets: Column, tags: Column, rows: Column) -> Column:
    """(i, s, e, tag, lp) of the tokens that cover more than white space: offsets trimmed, lp the log-probability of the token's tag."""

    def one(o: Column, i: Column) -> Column:
        s, e = trim_span(text, o["s"], o["e"])
        tag = F.get(tags, i)
        return F.struct(i.alias("i"), s.alias("s"), e.alias("e"), tag.alias("tag"), F.get(A.log_softmax(F.get(rows, i)), tag).alias("lp"))

    return F.filter(F.transform(offsets, one), lambda t: t["s"] < t["e"])


def spans(found: Column) -> Column:
    """All spans of ``tokens`` in order as (s, e, members, total): begin opens one, inside extends it or opens one where none is open, outside
    closes it. total is the sum of the members' log-probabilities."""
    empty = F.struct(F.array().cast(f"array<{_SPAN}>").alias("spans"), F.lit(False).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        fresh = F.struct(t["s"].alias("s"), t["e"].alias("e"), F.array(t["i"]).alias("members"), t["lp"].alias("total"))
        last = F.try_element_at(acc["spans"], F.lit(-1))
        longer = F.struct(
            F.least(last["s"], t["s"]).alias("s"), F.greatest(last["e"], t["e"]).alias("e"), F.array_append(last["members"], t["i"]).alias("members"),
            (last["total"] + t["lp"]).alias("total"))
        extended = F.concat(F.slice(acc["spans"], F.lit(1), F.greatest(F.size(acc["spans"]) - 1, F.lit(0))), F.array(longer))
        opens = (t["tag"] == BEGIN) | ((t["tag"] == INSIDE) & ~acc["open"])
        return F.struct(
            F.when(opens, F.array_append(acc["spans"], fresh)).when(t["tag"] == INSIDE, extended).otherwise(acc["spans"]).alias("spans"),
            (t["tag"] != OUTSIDE).alias("open"))

    return F.aggregate(found, empty, step)["spans"]


def confidence(span: Column) -> Column:
    """The geometric mean of the probabilities of a span's tags."""
    return F.exp(span["total"] / F.size(span["members"]))


def none_confidence(rows: Column, real: Column) -> Column:
    """How sure it is that there is no span: the least probability of outside over real tokens; 1 without any."""
    sure = F.zip_with(rows, real, lambda r, ok: F.when(ok, F.exp(F.get(A.log_softmax(r), F.lit(OUTSIDE)))))
    return F.coalesce(F.array_min(sure), F.lit(1.0))


def best_span(all_spans: Column) -> Column:
    """The span of greatest confidence, the earlier among equals; null if there is none."""
    ranked = F.transform(all_spans, lambda s, k: F.struct(confidence(s).alias("c"), (-k).alias("k")))
    return F.get(all_spans, -F.array_max(ranked)["k"])


def encode_tags(text: Column, offsets: Column, real: Column, start: Column, end: Column) -> Column:
    """Tags of the tokens for a span [start, end): the first real token that overlaps it begins, the others are inside; -100 where a token is
    not real. A null span gives outside everywhere."""

    def meets(o: Column, ok: Column) -> Column:
        s, e = trim_span(text, o["s"], o["e"])
        return ok & (s < e) & F.coalesce((s < end) & (e > start), F.lit(False))

    inside = F.zip_with(offsets, real, meets)
    first = F.array_position(inside, True) - 1
    return F.transform(inside, lambda hit, i: F.when(~F.get(real, i), -100).when(~hit, OUTSIDE).when(i == first, BEGIN).otherwise(INSIDE))


def token_indices(text: Column, offsets: Column, start: Column, end: Column) -> Column:
    """Places of the tokens that a span covers; empty for a null span."""

    def place(o: Column, i: Column) -> Column:
        s, e = trim_span(text, o["s"], o["e"])
        return F.when((s < e) & (s < end) & (e > start), i)

    return F.array_compact(F.transform(offsets, place))


def viterbi(rows: Column, moves: list[list[float]]) -> Column:
    """The tag path of greatest sum of scores and moves (from row to column); the lowest tag among equals. No rows give no tags."""
    width = len(moves)
    tags = F.array(*[F.lit(j) for j in range(width)])
    into = F.array(*[F.array(*[F.lit(float(moves[i][j])) for i in range(width)]) for j in range(width)])
    start = F.struct(F.get(rows, F.lit(0)).alias("totals"), F.transform(tags, lambda j: F.array(j)).alias("paths"))

    def step(acc: Column, row: Column) -> Column:
        ways = F.transform(tags, lambda j: F.array_max(F.zip_with(
            acc["totals"], F.zip_with(F.get(into, j), tags, lambda m, i: F.struct(m.alias("m"), (-i).alias("i"))),
            lambda t, x: F.struct((t + x["m"]).alias("t"), x["i"].alias("i")))))
        return F.struct(
            F.zip_with(ways, row, lambda w, r: w["t"] + r).alias("totals"),
            F.transform(ways, lambda w, j: F.array_append(F.get(acc["paths"], -w["i"]), j)).alias("paths"))

    last = F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), start, step)
    best = F.array_max(F.zip_with(last["totals"], tags, lambda t, j: F.struct(t.alias("t"), (-j).alias("j"))))
    return F.when(F.size(rows) == 0, F.array().cast("array<int>")).otherwise(F.get(last["paths"], -best["j"]))


def viterbi_masked(rows: Column, real: Column, moves: list[list[float]], fill: int = OUTSIDE) -> Column:
    """The path over the real tokens; ``fill`` elsewhere."""
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("r"), real.alias("ok")), lambda x: x["ok"]), lambda x: x["r"])
    path = viterbi(kept, moves)
    before = lambda i: F.size(F.filter(F.slice(real, F.lit(1), i + 1), lambda ok: ok))
    return F.transform(real, lambda ok, i: F.when(ok, F.get(path, before(i) - 1)).otherwise(fill))
