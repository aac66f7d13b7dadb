"""Token ids in a byte-aligned binary format: frequency ranks with separate control bytes.

Ids are replaced by their rank by frequency over the whole corpus, so that the usual ones need one byte. Each group
of four ranks has a control byte of four 2-bit lengths (1 to 4 bytes); control bytes and data bytes are
kept apart, so a table lookup of the control bytes tells all lengths and one gather reads all values.

A data set is a folder of shard files in ascending order of doc_id, and one file of the ids by rank. A shard
is a sequence of blocks; a block is a header of six 64-bit integers (magic, documents, ids, null doc_ids, control
bytes, data bytes), the doc_ids, the number of ids of each document, the control bytes and the data bytes. Null
doc_ids come first in order. All integers are little-endian.

Writing takes three passes: texts are dealt out by ranges of doc_id and encoded once, into blocks of plain ids
packed with zstd; ids are counted over all of them; then each part is written as a shard. Every task writes files of
its own name, and only names that tasks return count, so a repeated task leaves no duplicate.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import bytewords
from inkwell.llm.encoder import encoder
from inkwell.session import materialize, remove_path, scratch_path, small_batches

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 21
_MAGIC = 0x31534449
_LENGTHS = np.array([[((c >> (2 * k)) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    n = len(values)
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = length - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(length, dtype=np.int64) - length
    padded = np.frombuffer(data + bytes(8), np.uint8)
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    return (lanes[starts] & _MASKS[length]).astype(np.uint32)


def _write_block(out, doc_ids: np.ndarray, nulls: int, counts: np.ndarray, control: bytes, data: bytes) -> None:
    out.write(struct.pack("<6q", _MAGIC, len(counts), int(counts.sum()), nulls, len(control), len(data)))
    for part in (doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, data):
        out.write(part)


def _read_blocks(url: str) -> Iterator[tuple[np.ndarray, int, np.ndarray, bytes, bytes]]:
    with bytewords.open_in(url) as stream:
        while head := stream.read(48):
            magic, docs, _, nulls, c, d = struct.unpack("<6q", head)
            if magic != _MAGIC:
                raise ValueError(f"{url} is not a shard of token ids")
            doc_ids = np.frombuffer(stream.read(8 * docs), "<i8")
            counts = np.frombuffer(stream.read(8 * docs), "<i8")
            yield doc_ids, nulls, counts, stream.read(c), stream.read(d)


_FILES = "part int, path string, n_docs long, n_ids long"


def _encode_part(folder: str, path: str, end_id: int | None):
    """The function that encodes one range of documents into a file of plain ids."""

    def run(batches):
        tokenizer, out, url, docs, total = encoder(path), None, None, 0, 0
        packer = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            ids, counts, doc_ids = (np.concatenate(x) for x in zip(*held, strict=True))
            nulls = int((doc_ids == np.iinfo(np.int64).min).sum())
            width = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
            _write_block(out, doc_ids, nulls, counts, width.encode(), packer.compress(ids.astype(width).tobytes()))
            held.clear()

        for batch in batches:
            numbers = batch.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            for a, b, buffer, offsets in bytewords.slices_of(batch.column("__text"), 1 << 20):
                flat = buffer.tobytes()
                ids, counts = tokenizer.encode([flat[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                if out is None:
                    out, url = bytewords.open_out(folder, "ids")
                held.append((ids, counts, numbers[a:b]))
                docs, total = docs + len(counts), total + len(ids)
                if sum(len(x[0]) for x in held) >= BLOCK_IDS:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [url], "n_docs": [docs], "n_ids": [total]})

    return run


def _plain(url: str) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    reader = zstandard.ZstdDecompressor()
    for doc_ids, nulls, counts, width, data in _read_blocks(url):
        yield doc_ids, nulls, counts, np.frombuffer(reader.decompress(data), width.decode())


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for url in batch.column("path").to_pylist():
            for *_, ids in _plain(url):
                got = np.bincount(ids)
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})


def _dealt(files: DataFrame, most: int | None = None) -> DataFrame:
    """One small row for each file, spread over as many tasks, ``most`` at most."""
    n = max(1, files.count())
    return files.repartition(min(n, most or n))


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID, text: str = "text") -> DataFrame:
    """Encode whole texts (null: empty), end each with ``end_id``, and write them as a data set in ``folder``; returns its
    shards (part, path, n_docs, n_ids, start): start is the number of ids in all earlier shards.

    Documents are in ascending order of doc_id (null first), those that repeat a doc_id by text hash.
    Rows of one doc_id may be spread over several shards. An empty table gives no shard.
    """
    spark = docs.sparkSession
    order = ["doc_id", "__h", "__m"]
    keyed = docs.select(
        F.col("doc_id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__h"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("__m"))
    parts = max(keyed.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = scratch_path(spark, "plain-ids")
    with small_batches(spark):
        plain = materialize(
            keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "__text")
            .mapInArrow(bytewords.lean(_encode_part(work, path, end_id)), _FILES), "plain")
    tasks = 2 * spark.sparkContext.defaultParallelism  # each brings one row for each id at most
    counted = _dealt(plain.select("path"), tasks).mapInArrow(bytewords.lean(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counted.orderBy(F.col("n").desc(), "id").toArrow()  # at most the vocabulary's size
    by_rank = ranked["id"].to_numpy().astype(np.uint32)
    out, _ = bytewords.open_out(folder, "ranks")
    with out:
        out.write(by_rank.astype("<u4").tobytes())
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    def shards(batches):
        table = ranks.value
        for batch in batches:
            for row in batch.to_pylist():
                out, url = bytewords.open_out(folder, f"shard-{row['part']:06d}")
                with out:
                    for doc_ids, nulls, counts, ids in _plain(row["path"]):
                        _write_block(out, doc_ids, nulls, counts, *pack(table[ids]))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]], pa.int32()), "path": [url], "n_docs": [row["n_docs"]], "n_ids": [row["n_ids"]]})

    written = materialize(_dealt(plain).mapInArrow(bytewords.lean(shards), _FILES), "shards")
    remove_path(spark, work)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, folder: str, shards: DataFrame, digest: bool = False) -> DataFrame:
    """Read a data set back: doc_id, start, n_tokens and ids, or with ``digest`` ids_crc32 (the CRC-32 of the ids as
    little-endian unsigned 32-bit integers) in their place. One task for each shard, block by block."""
    system_ranks = _ranks_file(folder)

    def run(batches):
        by_rank = np.frombuffer(bytewords.read_all(system_ranks), "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for doc_ids, nulls, counts, control, data in _read_blocks(row["path"]):
                    ids = by_rank[unpack(control, data, int(counts.sum()))].astype("<u4")
                    ends = np.cumsum(counts)
                    flat, cut = memoryview(ids.tobytes()), np.concatenate(([0], ends)).tolist()
                    pieces = [flat[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, pa.int64(), mask=np.arange(len(doc_ids)) < nulls),
                        pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(p) for p in pieces], pa.int64()) if digest
                        else pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in pieces], pa.list_(pa.int64())),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                    start += int(ends[-1]) if len(ends) else 0

    last = "ids_crc32 long" if digest else "ids array<long>"
    return _dealt(shards).mapInArrow(bytewords.lean(run), f"doc_id long, start long, n_tokens long, {last}")


def _ranks_file(folder: str) -> str:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
    found = [f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("ranks-")]
    return f"{folder.rstrip('/')}/{found[0]}"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` and read the files back: doc_id, start, n_tokens, ids_crc32. A null text is empty, that is its end id alone; null
    ids come first; repeated rows repeat; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    return read_ids(spark, folder, materialize(write_ids(docs, folder, path), "shards"), digest=True)
