"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints come from 3-word shingles. The 64 bits are cut into ``SEGMENTS`` segments on a ring. When two
fingerprints differ in at most ``radius`` bits, some segment starts a chain around the ring in which every
prefix of k segments has at most floor(k * radius / SEGMENTS) differing bits (the cycle lemma). A chain
of five of the eight segments holds at most one difference for radius 3 and begins with two equal
segments, so two fingerprints within the radius agree on one of 24 patterns of four whole segments: 32
bits. Candidates meet in an equi-join on (pattern, those bits); each is pruned by the whole chain's
cumulative budgets before the full Hamming check. No pair within the radius is missed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bytewords
from inkwell.operators.graph import components
from inkwell.session import fresh, materialize, scratch_path, small_batches

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
CHAIN = 5
RADIUS = 3
SHINGLE = 3
SEED = 42
_SLICE = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = np.array(hashes[at : at + _SLICE], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp (the fingerprint as a signed long). One Arrow pass, no shuffle."""
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("__text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"]
            )

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*fields, StructField("fp", LongType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(bytewords.lean(run), schema)


def budgets(radius: int = RADIUS) -> list[int]:
    """Differences that a chain's first k segments may hold, for k = 1, 2, ... SEGMENTS."""
    return [k * radius // SEGMENTS for k in range(1, SEGMENTS + 1)]


def patterns(radius: int = RADIUS, chain: int = CHAIN) -> list[tuple[int, int]]:
    """(start segment, mask of the segments that must agree) for every way in which a chain of ``chain``
    segments within its budgets can spread its differing segments."""
    most = budgets(radius)
    spare = most[chain - 1]
    ways = [
        d for d in itertools.combinations(range(chain), spare)
        if all(sum(x < k for x in d) <= most[k - 1] for k in range(1, chain + 1))
    ]
    found = []
    for start in range(SEGMENTS):
        for differing in ways:
            same = [(start + k) % SEGMENTS for k in range(chain) if k not in differing]
            found.append((start, sum(((1 << WIDTH) - 1) << (WIDTH * s) for s in same)))
    return found


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _segment(x: Column, s: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(x, WIDTH * (s % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1))


def _chain_holds(x: Column, start: int, most: list[int]) -> Column:
    """Whether every prefix of the chain from ``start`` stays in its budget of the differing bits x."""
    seen, test = F.lit(0), F.lit(True)
    for k in range(SEGMENTS - 1):  # the whole ring is the Hamming check itself
        seen = seen + _segment(x, start + k)
        test = test & (seen <= most[k])
    return test


def links(distinct_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b: every pair of the distinct fingerprints within ``radius`` bits, once each.

    One shuffle of 24 short keys for each fingerprint; the join is an equi-join, which adaptive execution
    may split where a key is hot. A pair that meets under several patterns is kept under the first only.
    """
    ways, most = patterns(radius), budgets(radius)
    keys = distinct_fps.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(p).alias("p"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
            for p, (_, m) in enumerate(ways)
        ])).alias("e"),
    ).select("fp", "e.p", "e.k")
    left, right = keys.alias("l"), keys.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    first = F.coalesce(*[
        F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(p)) for p, (_, m) in enumerate(ways)
    ])
    # A pair within the radius need not satisfy the chain of its first shared pattern, only some chain.
    chained = F.lit(False)
    for start in range(SEGMENTS):
        chained = chained | _chain_holds(x, start, most)
    return left.join(
        right,
        (F.col("l.p") == F.col("r.p")) & (F.col("l.k") == F.col("r.k")) & (F.col("l.fp") < F.col("r.fp"))
        & chained & (F.bit_count(x) <= radius) & (first == F.col("l.p")),
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def _grouped(docs: DataFrame, radius: int, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """``keep`` and fp of every row; and fp, the least doc_id and the component's root (one of its fingerprints) of every fingerprint."""
    with small_batches(docs.sparkSession):
        marked = materialize(fingerprints(docs, keep=keep), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = links(classes.select("fp"), radius)
    parts = components(edges)
    return marked, classes.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id reachable, the document's own included. Null and empty texts have fingerprint zero and link
    like any other. A repeated row appears again; rows with a null doc_id get the component of their
    fingerprint (null if the whole component has no doc_id). An empty table gives no rows. Other columns
    are ignored, whatever their names.

    Equal fingerprints collapse by a partial aggregate before any join, so a group of thousands of copies
    counts as one.
    """
    marked, rooted = _grouped(docs, radius)
    small = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(small, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def only_rows(numbered: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of a stored table whose number ``row`` (of monotonically_increasing_id) stands in ``kept``, without a shuffle of the table: for
    each partition that gave numbers a bitmap of the kept ones is written to the shared folder, and whoever reads rows of it looks there.
    Each bitmap has a bit for each row of one partition; the driver sees one file name for each partition."""
    spark = numbered.sparkSession
    folder = scratch_path(spark, "bitmaps")

    def write(batches):
        part, held = None, []

        def flush():
            at = np.concatenate(held)
            bits = np.zeros((int(at.max()) >> 3) + 1, np.uint8)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            out, url = bytewords.open_out(folder, f"part-{part:08d}")
            with out:
                out.write(bits.tobytes())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [url]})

        for batch in batches:
            numbers = batch.column("row").to_numpy()
            parts = numbers >> 33
            for p in np.unique(parts).tolist():
                if p != part and held:
                    yield flush()
                    held = []
                part = p
                held.append(numbers[parts == p] & ((1 << 33) - 1))
        if held:
            yield flush()

    by_part = kept.select(F.col(row).alias("row")).repartition(F.shiftright("row", 33)).sortWithinPartitions("row")
    files = materialize(by_part.mapInArrow(write, "part int, path string"), "bitmaps")
    paths = spark.sparkContext.broadcast({p: url for p, url in files.collect()})

    def read(batches):
        part, bits = None, np.zeros(0, np.uint8)
        for batch in batches:
            numbers = batch.column(row).to_numpy()
            parts, at = numbers >> 33, numbers & ((1 << 33) - 1)
            keep = np.zeros(len(numbers), bool)
            for p in np.unique(parts).tolist():
                if p != part:
                    part, bits = p, np.frombuffer(bytewords.read_all(paths.value[p]), np.uint8) if p in paths.value else bits[:0]
                mine = np.flatnonzero((parts == p) & (at >> 3 < len(bits)))
                keep[mine] = (bits[at[mine] >> 3] >> (at[mine] & 7)) & 1
            yield batch.filter(pa.array(keep))

    return numbered.mapInArrow(bytewords.lean(read), numbered.schema)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns kept, one for each near-duplicate component: that of its smallest
    doc_id, null ids last. Of rows with that doc_id in the component the one least by text hash, then text length, stays;
    if such rows agree in their whole text, one of them, whichever it be.

    Rows are told apart by their own number, not by doc_id: null ids and texts that share a doc_id each count in the component of
    their own text. Texts are not shuffled. Null and empty texts are one component, so one of them stays. An empty table gives no rows; columns may have any name.
    Components meet by partial aggregates, so a group of copies counts once for each task.
    """
    row, th, size = (fresh(docs, x) for x in ("row", "th", "size"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keys = numbered.select("doc_id", F.xxhash64("text").alias(th), F.length("text").alias(size), row, "text")
    marked, rooted = _grouped(keys, radius, ("doc_id", th, size, row))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(th), F.col(size), F.col(row).alias("row"))
    firsts = marked.groupBy("fp").agg(F.min(order).alias("m"))  # one row for each fingerprint before the join
    kept = firsts.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("m").alias("m"))
    kept = materialize(kept.select(F.col("m.row").alias(row)), "kept")
    return only_rows(numbered, row, kept).select(*[F.col(f"`{c}`") for c in docs.columns])
