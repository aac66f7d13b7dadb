"""Interpolated modified Kneser-Ney model of any order from 2: counted in Spark, stored as sorted hash arrays, mapped by workers.

Tokens are words in lower-cased (A-Z) text and one end token for each document; a start mark is a context only.
Nothing is pruned or sampled: every training token counts.

Counting is one job. Map tasks hash tokens in numpy, count distinct n-grams of the full order and words of some millions of tokens
at a time, and send them packed, by ranges of their hash, so no shard depends on how often one word occurs. One step for each order,
from the highest to 2, merges its n-grams, writes them as sorted arrays to the shared folder, and sends on what they add to
the next: an n-gram of a lower order counts in how many distinct contexts it occurs, or, at the start of a document, how often. From order
3 shards are ranges of the context's hash, so each also writes its contexts: their successors' counts in total, and how many follow once, twice and
more often. A context that is followed once only is not written: its own n-gram, of the order below, tells of it. Order 2 sends the same statistics of its words on to a last step, which merges them by word and writes the word arrays. The
driver sees a few totals of each shard.

Scoring is one pass over the texts: workers map the arrays from the shared folder and look up each batch's
distinct words and bigrams in hash order, so reads go forward through each file and the pages are shared by all workers of
a machine. Where the shared folder has no path on the machine, a file that is needed is copied once to Spark's folder there and mapped.

N-grams are identified by 40 bits beyond their shard's (48 where shards are large) of a hash of the upper 48 bits of their words' hashes, words by 64 bits. The number
of shards follows the bytes of the training texts.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from inkwell.llm import bytewords
from inkwell.session import materialize, scratch_path, small_batches

START = np.uint64(0x5D1E5A2B7C3F9E01)
END = np.uint64(0xA7C1D3E5F70B9D02)
#: Words of the longest n-grams that the registered query counts.
ORDER = 3
FLUSH_TOKENS = 4_000_000
SHARD_BYTES = 64 << 20  # of text, for one shard of the model
LEAST_BITS = 4
_LOW = np.uint64(16)
_MOST_BITS = 16  # of a context's hash that its n-grams' keys begin with
_ROWS = "kind int, shard int, blob binary"


class Table:
    """A stored table of sorted keys with small numbers: the arrays of the keys' upper 32 and lower bits, four or eight bits for each number, and
    those that don't fit beside them. It is read where it lies in a mapped file."""

    HEAD = struct.Struct("<qqqqq")  # keys, bytes of a key's lower part, fields, bits of a number, numbers kept beside

    def __init__(self, data: np.ndarray):
        n, low, self.fields, self.bits, more = self.HEAD.unpack(data[: self.HEAD.size].tobytes()) if len(data) else (0, 2, 0, 8, 0)
        cuts = np.cumsum([self.HEAD.size, 4 * n, low * n, (self.fields * n * self.bits + 7) // 8, 8 * more, 8 * more]).tolist()
        part = [data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        self.n, self.low_bits = n, 8 * low
        self.high, self.low = part[0].view("<u4"), part[1].view(f"<u{low}")
        self.small, self.places, self.more = part[2], part[3].view("<i8"), part[4].view("<i8")

    @classmethod
    def pack(cls, keys: np.ndarray, low_bits: int, columns: list[np.ndarray], bits: int = 8) -> bytes:
        """The bytes of a table. keys: sorted, of 32 + low_bits bits. bits: 4 or 8, of the numbers that are not kept beside."""
        flat = np.concatenate(columns) if columns else np.zeros(0, np.int64)
        most = (1 << bits) - 1
        places = np.flatnonzero(flat >= most)
        small = np.minimum(flat, most).astype(np.uint8)
        if bits == 4:
            small = np.concatenate((small, np.zeros(len(small) % 2, np.uint8)))
            small = small[::2] | small[1::2] << 4
        high, low = (keys >> np.uint64(low_bits)).astype("<u4"), (keys & np.uint64((1 << low_bits) - 1)).astype(f"<u{low_bits // 8}")
        return b"".join([
            cls.HEAD.pack(len(keys), low_bits // 8, len(columns), bits, len(places)), high.tobytes(), low.tobytes(), small.tobytes(),
            places.astype("<i8").tobytes(), flat[places].astype("<i8").tobytes()])

    def _numbers(self, places: np.ndarray) -> np.ndarray:
        if self.bits == 8:
            value = self.small[places].astype(np.int64)
        else:
            value = (self.small[places >> 1] >> (4 * (places & 1)).astype(np.uint8) & 15).astype(np.int64)
        large = np.flatnonzero(value == (1 << self.bits) - 1)
        value[large] = self.more[np.searchsorted(self.places, places[large])]
        return value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The fields of sorted keys, as rows; 0 where there is no such key."""
        out = np.zeros((self.fields, len(keys)), np.int64)
        if not self.n or not len(keys):
            return out
        high, low = (keys >> np.uint64(self.low_bits)).astype("<u4"), (keys & np.uint64((1 << self.low_bits) - 1)).astype(self.low.dtype)
        at = np.searchsorted(self.high, high)
        todo = np.flatnonzero(at < self.n)
        todo = todo[self.high[at[todo]] == high[todo]]
        hits = []
        while len(todo):  # few keys share their upper part
            right = self.low[at[todo]] == low[todo]
            hits.append(todo[right])
            todo = todo[~right]
            at[todo] += 1
            todo = todo[at[todo] < self.n]
            todo = todo[self.high[at[todo]] == high[todo]]
        hit = np.concatenate(hits) if hits else todo
        for f in range(self.fields):
            out[f, hit] = self._numbers(at[hit] + f * self.n)
        return out


def _stored_keys(keys: np.ndarray, bits: int, low: int) -> np.ndarray:
    """The 32 + ``low`` bits of n-gram keys that follow the first ``bits``, which the shard has."""
    return (keys << np.uint64(bits)) >> np.uint64(32 - low)


def tokens(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (ends included), hashes of the token before each, and each document's first token's number (with
    the total at the end)."""
    buffer = bytewords.lower_ascii(buffer)
    starts, sizes, firsts = bytewords.words_of(buffer, offsets)
    docs = len(offsets) - 1
    places = firsts + np.arange(docs + 1)
    h = np.empty(len(starts) + docs, np.uint64)
    ends = places[1:] - 1
    is_word = np.ones(len(h), bool)
    is_word[ends] = False
    h[is_word] = bytewords.hash_slices(buffer, starts, sizes)
    h[ends] = END
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[places[:-1]] = START
    return h, before, places


def bigram_keys(before48: np.ndarray, word48: np.ndarray) -> np.ndarray:
    return bytewords.mix(bytewords.mix(before48 + np.uint64(0x9E3779B97F4A7C15)) ^ (word48 * np.uint64(0xD6E8FEB86659FD93)))


def histories(before: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """The ``order`` - 1 tokens before each token, the nearest first; beyond a document's start they are start marks."""
    found = [before]
    while len(found) < order - 1:
        earlier = np.empty_like(before)
        earlier[1:] = found[-1][:-1]
        earlier[places[:-1]] = START
        found.append(earlier)
    return found


def gram_keys(words48: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    """Keys of n-grams given as columns of words, and from three words on keys of their contexts, of which the former have the
    first bits."""
    key, context = bigram_keys(words48[0], words48[1]), None
    for w in words48[2:]:
        context = bytewords.mix(key)
        rest = np.uint64(64 - _MOST_BITS)
        key = (context >> rest << rest) | (bigram_keys(context, w) >> np.uint64(_MOST_BITS))
    return key, context


def _keys_of(words: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    """``gram_keys`` of n-grams given as columns of places in ``words``, some at a time."""
    keys, contexts = np.empty(len(columns[0]), np.uint64), np.empty(len(columns[0]), np.uint64) if len(columns) > 2 else None
    for a in range(0, len(keys), 1 << 19):
        part, above = gram_keys([words[x[a : a + (1 << 19)]] for x in columns])
        keys[a : a + len(part)] = part
        if contexts is not None:
            contexts[a : a + len(part)] = above
    return keys, contexts


def _planes(values: np.ndarray, size: int) -> bytes:
    """The lower ``size`` bytes of each value, all first bytes, then all second bytes and so on."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8").reshape(-1)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2 ** 64."""
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0))


def _put(columns: list[bytes]) -> bytes:
    body = b"".join(columns)
    return struct.pack("<B", len(columns)) + struct.pack(f"<{len(columns)}Q", *map(len, columns)) + zstandard.ZstdCompressor(level=3).compress(body)


def _get(blob: bytes) -> list[bytes]:
    n = blob[0]
    sizes = struct.unpack_from(f"<{n}Q", blob, 1)
    body = zstandard.ZstdDecompressor().decompress(blob[1 + 8 * n :])
    cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return [body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pack_grams(columns: list[np.ndarray], words: np.ndarray, n: np.ndarray) -> bytes:
    """n-grams, given as columns of places in ``words`` (48 bits each), and their counts: the words that occur, by powers of 2 of their frequency
    and then by value, and the n-grams as sorted places in them; all byte by byte, which compresses well."""
    counts = np.bincount(np.concatenate(columns), minlength=len(words))
    used = np.flatnonzero(counts)
    used = used[np.lexsort((words[used], -np.log2(counts[used]).astype(np.int64)))]
    place = np.empty(len(words), np.uint32)
    place[used] = np.arange(len(used), dtype=np.uint32)
    places = place[np.stack(columns)]
    rows = np.lexsort(places[::-1])
    places, n = places[:, rows], n[rows]
    places[0, 1:] = np.diff(places[0])
    told = _put([_planes(_steps(words[used]), 6)])
    return struct.pack("<QQ", len(told), len(n)) + told + _put([_planes(x, 4) for x in (*places, n)])


def _unpack_grams(blobs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted words, the columns of places in them, and the counts of all n-grams that ``_pack_grams`` packed in ``blobs``, one blob after
    the other; the list is emptied."""
    mask, heads = np.uint64((1 << 48) - 1), [struct.unpack_from("<QQ", x) for x in blobs]
    words = [np.cumsum(_from_planes(_get(x[16 : 16 + size])[0], 6), dtype=np.uint64) & mask for x, (size, _) in zip(blobs, heads, strict=True)]
    every = np.unique(np.concatenate(words))
    whole: list[np.ndarray] = []
    at = 0
    while blobs:
        (size, n), held = heads.pop(), words.pop()
        told = _get(blobs.pop()[16 + size :])
        if not whole:
            total = n + sum(k for _, k in heads)
            whole = [np.empty(total, np.uint32) for _ in told]
        place = np.searchsorted(every, held).astype(np.uint32)
        for k, (out, data) in enumerate(zip(whole, told, strict=True)):
            x = _from_planes(data, 4).astype(np.uint32)
            x = np.cumsum(x, dtype=np.uint32) if k == 0 else x
            out[at : at + n] = x if k == len(whole) - 1 else place[x]
        at += n
    return every, whole[:-1], whole[-1]


def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    """First places of the 2**bits ranges of sorted keys, with the end."""
    if not bits:
        return np.array([0, len(keys)])
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, shards, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "shard", "blob"])


def _map(bits: int, order: int):
    def flush(parts):
        begins = np.concatenate([x + a for (_, x), a in zip(parts, np.cumsum([0, *[len(x) for x, _ in parts]]), strict=False)])
        h = np.concatenate([x for x, _ in parts])
        parts.clear()
        words, ids, counts = np.unique(h, return_inverse=True, return_counts=True)
        del h
        cuts = _shards(words, bits)
        for s in range(1 << bits):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                yield 0, s, _put([_planes(_steps(words[a:b]), 8), _planes(counts[a:b], 8)])
        words = np.concatenate((words, [START])) >> _LOW
        columns = [ids.astype(np.uint32)]
        del ids
        while len(columns) < order:
            earlier = np.empty_like(columns[0])
            earlier[1:] = columns[0][:-1]
            earlier[begins] = len(words) - 1
            columns.insert(0, earlier)
        width = np.uint64(len(words).bit_length())
        if int(width) * order <= 64:  # the places themselves tell n-grams apart
            packed = columns[0].astype(np.uint64)
            for x in columns[1:]:
                packed <<= width
                packed |= x
            packed.sort()
            first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
            counts = np.diff(np.append(first, len(packed)))
            packed = packed[first]
            columns = [((packed >> (width * np.uint64(order - 1 - i))) & ((np.uint64(1) << width) - np.uint64(1))).astype(np.uint32) for i in range(order)]
            del packed
            keys, _ = _keys_of(words, columns)
            first = np.argsort(keys)
            keys, counts = keys[first], counts[first]
        else:
            keys, first, counts = np.unique(_keys_of(words, columns)[0], return_index=True, return_counts=True)
        cuts = _shards(keys, bits)
        for s in range(1 << bits):
            at = first[cuts[s] : cuts[s + 1]]
            if len(at):
                yield order, s, _pack_grams([x[at] for x in columns], words, counts[cuts[s] : cuts[s + 1]])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, buffer, offsets in bytewords.slices_of(batch.column("text")):
                h, _, places = tokens(buffer, offsets)
                held.append((h, places[:-1]))
                size += len(h)
                if size >= FLUSH_TOKENS:
                    yield from map(_batch, ([x] for x in flush(held)))
                    size = 0
        if held:
            yield from map(_batch, ([x] for x in flush(held)))

    return run


def _by_shard(batches) -> dict[int, dict[int, list[bytes]]]:
    found: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for kind, shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found.setdefault(shard, {}).setdefault(kind, []).append(blob)
    return found


def _merge(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the first place of each, and sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], order[first], *(np.add.reduceat(v[order], first, dtype=np.int64) if len(first) else v[:0].astype(np.int64) for v in values))


def _sums(n: np.ndarray) -> list[np.ndarray]:
    """What n-grams of the counts n add to their context: the count, and whether they follow once, twice and more often."""
    return [n, *[x.astype(np.int64) for x in (n == 1, n == 2, n >= 3)]]


def _reduce(folder: str, bits: int, low: int, k: int):
    """Merge and store the n-grams of k words; send on what they add to those of k - 1 words."""

    def write(name, keys, *columns):
        out, url = bytewords.open_out(folder, name)
        with out:
            out.write(Table.pack(_stored_keys(keys, bits, low), low, list(columns), 4))
        return url

    def run(batches):
        for shard, kinds in sorted(_by_shard(batches).items()):
            rows = [(kind, shard, x) for kind in (-2, -1) for x in kinds.get(kind, [])]
            if 0 in kinds:
                told = [_get(x) for x in kinds.pop(0)]
                words = np.concatenate([np.cumsum(_from_planes(x[0], 8), dtype=np.uint64) for x in told])
                words, _, counts = _merge(words, np.concatenate([_from_planes(x[1], 8).astype(np.int64) for x in told]))
                out, url = bytewords.open_out(folder, f"counts-{shard:06d}")  # only its name goes on
                with out:
                    out.write(_put([_planes(_steps(words), 8), _planes(counts, 8)]))
                rows.append((-2, shard, url.encode()))
                del told, words, counts
            if k in kinds:
                words, columns, n = _unpack_grams(kinds.pop(k))
                keys, at, n = _merge(_keys_of(words, columns)[0], n)
                columns = [x[at] for x in columns]
                del at
                told = {"k": k, "contexts": None}
                if k == 2:
                    told["grams"] = write(f"grams-2-{shard:06d}", keys, n)
                    ones = n
                    # What each 48-bit hash gains, as the later word and as the context.
                    first, later = columns
                    sums = [np.bincount(later, minlength=len(words)), *[
                        np.bincount(first, weights=x, minlength=len(words)).astype(np.int64) for x in _sums(n)]]
                    cuts = _shards(words << _LOW, bits)
                    for s in range(1 << bits):
                        a, b = cuts[s], cuts[s + 1]
                        if b > a:
                            rows.append((1, s, _put([_planes(_steps(words[a:b]), 6), *[_planes(x[a:b], 8) for x in sums]])))
                else:
                    # Beyond a document's start stand no n-grams of this order; their counts are those of the next order's first ones.
                    padded = words[columns[1]] == START >> _LOW
                    ones = n[~padded]
                    told["grams"] = write(f"grams-{k}-{shard:06d}", keys[~padded], ones)
                    found, _, *sums = _merge(_keys_of(words, columns)[1][~padded], *_sums(ones))
                    several = sums[0] > 1  # a context that is followed once only needs no place: its own n-gram is known
                    told["contexts"] = write(f"contexts-{k}-{shard:06d}", found[several], *[x[several] for x in sums])
                    del keys, found, sums
                    suffix, _ = _keys_of(words, columns[1:])
                    suffix, at, n = _merge(suffix, np.where(padded, n, 1))
                    columns = [x[at] for x in columns[1:]]
                    cuts = _shards(suffix, bits)
                    for s in range(1 << bits):
                        a, b = cuts[s], cuts[s + 1]
                        if b > a:
                            rows.append((k - 1, s, _pack_grams([x[a:b] for x in columns], words, np.minimum(n[a:b], 0xFFFFFFFF))))
                told["n"] = [int((ones == i).sum()) for i in (1, 2, 3, 4)]
                rows.append((-1, shard, _put([json.dumps(told).encode()])))
            if rows:
                yield _batch(rows)

    return run


_TOTALS = ("n_tokens", "n_words", "distinct", *[f"m{k}" for k in range(1, 5)], *[f"s{k}" for k in range(1, 4)])
_MANIFEST = "shard int, words string, levels string, " + ", ".join(f"{x} long" for x in _TOTALS)


def _finish(folder: str):
    def run(batches):
        for shard, kinds in sorted(_by_shard(batches).items()):
            row = dict.fromkeys(_TOTALS, 0) | {"shard": shard, "words": None}
            row["levels"] = json.dumps([json.loads(_get(x)[0]) for x in kinds.get(-1, [])])
            stats = [_get(x) for x in kinds.get(1, [])]
            h48 = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(_from_planes(x[0], 6), dtype=np.uint64) for x in stats]])
            h48, _, *sums = _merge(h48, *[
                np.concatenate([np.zeros(0, np.int64), *[_from_planes(x[1 + k], 8).astype(np.int64) for x in stats]]) for k in range(5)])
            words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if -2 in kinds:
                words, counts = _get(bytewords.read_all(kinds[-2][0].decode()))
                words, counts = np.cumsum(_from_planes(words, 8), dtype=np.uint64), _from_planes(counts, 8).astype(np.int64)
            is_start = h48 == START >> _LOW
            keys = np.concatenate((words, np.full(int(is_start.any()), START)))
            at = np.searchsorted(h48, keys >> _LOW)
            order = np.argsort(keys)
            columns = [keys[order], np.concatenate((counts, np.zeros(len(keys) - len(words), np.int64)))[order], *[x[at][order] for x in sums]]
            out, row["words"] = bytewords.open_out(folder, f"words-{shard:06d}")
            with out:
                out.write(Table.pack(columns[0], 32, columns[1:]))
            cont = sums[0]
            real = cont > 0
            row |= {"n_tokens": int(counts.sum()), "n_words": len(words), "distinct": int(cont.sum())}
            row |= {f"m{k}": int((cont == k).sum()) for k in (1, 2, 3, 4)} | {"s1": int((cont == 1).sum()), "s2": int((cont == 2).sum()), "s3": int((cont >= 3).sum())}
            assert real.sum() <= len(h48)
            yield pa.RecordBatch.from_pylist([row], schema=_arrow_manifest())

    return run


def _arrow_manifest() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("words", pa.string()), ("levels", pa.string()), *[(x, pa.int64()) for x in _TOTALS]])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more; 0.5, 1 and 1.5 where the counts of counts give none
    above 0 and within the count."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[d if 0 < d <= k else k / 2 for k, d in enumerate(found, 1)]])


class Model:
    """The stored arrays and totals. Instances travel to workers as paths and a few numbers."""

    def __init__(self, bits: int, low: int, rows: list[dict], order: int = 2):
        self.bits, self.low, self.order = bits, low, order
        self.paths = {r["shard"]: r["words"] for r in rows}
        self.levels: dict[int, dict[int, dict]] = {k: {} for k in range(2, order + 1)}
        for r in rows:
            for x in json.loads(r["levels"]):
                self.levels[x["k"]][r["shard"]] = x
        total = {k: sum(r[k] for r in rows) for k in _TOTALS}
        self.n, self.v, self.distinct = total["n_tokens"], total["n_words"], total["distinct"]
        self.d = {k: discounts(*np.sum([x["n"] for x in found.values()] or [[0] * 4], axis=0).tolist()) for k, found in self.levels.items()}
        self.d1 = discounts(*[total[f"m{k}"] for k in range(1, 5)])
        spare = sum(self.d1[k] * total[f"s{k}"] for k in (1, 2, 3))
        self.rest = spare / self.distinct if self.distinct else 1.0
        self.open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _table(self, url: str) -> Table:
        if url not in self.open:
            self.open[url] = Table(bytewords.mapped(url))
        return self.open[url]

    def words(self, keys: np.ndarray) -> np.ndarray:
        """(count, contexts, successors' total, once, twice, more) as rows of 64-bit integers for sorted distinct hashes; 0 if unknown."""
        out = np.zeros((6, len(keys)), np.int64)
        cuts = _shards(keys, self.bits)
        for s, url in self.paths.items():
            a, b = cuts[s], cuts[s + 1]
            if url and b > a:
                out[:, a:b] = self._table(url).find(keys[a:b])
        return out

    def find(self, k: int, part: str, keys: np.ndarray) -> np.ndarray:
        """The fields of the grams or contexts of order k, as rows for sorted distinct keys; 0 if unknown."""
        out = np.zeros((1 if part == "grams" else 4, len(keys)), np.int64)
        cuts = _shards(keys, self.bits)
        for s, told in self.levels[k].items():
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                out[:, a:b] = self._table(told[part]).find(_stored_keys(keys[a:b], self.bits, self.low))
        return out

    def logs(self, h: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each token after the ``order`` - 1 before it (``histories``), its base log10 probability, and whether it is
        known."""
        words, inverse = np.unique(np.concatenate((h, before[0])), return_inverse=True)
        told = self.words(words)
        own, context = told[:, inverse[: len(h)]], told[:, inverse[len(h) :]]
        base = np.log10((own[0] + 1) / (self.n + self.v + 1))
        cont = own[1]
        p = np.maximum(cont - self.d1[np.minimum(cont, 3)], 0) / max(1, self.distinct) + self.rest / (self.v + 1)
        shorter = n = own[0]
        for k, d in self.d.items():
            shorter, grams = n, [x >> _LOW for x in (*before[: k - 1][::-1], h)]
            keys, contexts = gram_keys(grams)
            keys, back = np.unique(keys, return_inverse=True)
            n = self.find(k, "grams", keys)[0][back]
            if k == 2:
                seen, once, twice, more = context[2:]
            else:
                # The context is the n-gram of the order below that ends with the token before; it can't begin before the document.
                known = np.concatenate(([False], shorter[:-1] > 0)) & (before[k - 3] != START)
                asked, back = np.unique(contexts[known], return_inverse=True)
                told = np.zeros((4, len(h)), np.int64)
                told[:, known] = self.find(k, "contexts", asked)[:, back]
                seen, once, twice, more = told
                alone = known & (seen == 0)
                seen[alone] = once[alone] = 1
            follows = d[1] * once + d[2] * twice + d[3] * more
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(seen > 0, (np.maximum(n - d[np.minimum(n, 3)], 0) + follows * p) / seen, p)
        return np.log10(p), base, own[0] > 0


def held_out() -> Column:
    """crc32 of doc_id as text leaves remainder 2 by 7; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


def train(docs: DataFrame, order: int = 2) -> Model:
    """Count the training rows of ``docs`` and store the model in the shared folder. A null text is an empty one, that is one end
    token. Repeated rows count as often as they stand there."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = docs.sparkSession
    folder = scratch_path(spark, "ngram-model")
    learned = docs.where(~held_out()).select("text")
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(_MOST_BITS, max(LEAST_BITS, (size // SHARD_BYTES).bit_length()))
    low = 8 if size >> bits <= 4 * SHARD_BYTES else 16  # a wrong hit has the odds of a shard's n-grams in 2 ** (32 + low)
    parts = 1 << bits
    counted = learned.mapInArrow(bytewords.lean(_map(bits, order)), _ROWS)
    for k in range(order, 1, -1):
        counted = counted.repartitionById(parts, F.col("shard")).mapInArrow(bytewords.lean(_reduce(folder, bits, low, k)), _ROWS)
    with small_batches(spark, 10_000):
        done = materialize(counted.repartitionById(parts, F.col("shard")).mapInArrow(bytewords.lean(_finish(folder)), _MANIFEST), "manifest")
    return Model(bits, low, [r.asDict() for r in done.collect()], order)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Whole texts; a null or empty text is one end token. With nothing learned every probability is 1. Repeated
    rows repeat; an empty table gives no rows; other columns are ignored. Perplexity is 10 ** (-score / n_tokens).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, buffer, offsets in bytewords.slices_of(batch.column("__text")):
                h, before, places = tokens(buffer, offsets)
                p, base, known = model.logs(h, *histories(before, places, model.order))
                rows = batch.slice(a, b - a)
                sums = [np.add.reduceat(x, places[:-1]) for x in (known.astype(np.int64), base, p)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(places)), pa.array(sums[0]),
                     pa.array(np.full(b - a, model.n, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=[f.name for f in schema])

    schema = StructType([
        docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()),
        StructField("train_tokens", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("__text")).mapInArrow(bytewords.lean(run), schema)
