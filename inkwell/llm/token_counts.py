"""Token counts by compiled finite-state transducers.

Two deterministic transducers in a row: the pre-tokenizer over character classes (``pretoken``), whose chunk state maps
are composed by a parallel prefix scan, and one over the bytes of pre-tokens whose transitions carry the number of
tokens that the byte adds to the encoding (which may be negative when tokens merge).

The second is compiled from the merge list while it runs, as regular-expression engines do. Let the encoding of a
prefix end with some token; a sequence of tokens is the encoding of its bytes exactly if every two neighbours
are. So what the future needs to know of a prefix is, for every suffix that begins some vocabulary entry: its node in
the vocabulary's trie, the last token before it, and how many tokens there were up to it relative to now. That tuple is the
state; all pre-tokens of a slice of text step through the transition table together, one byte at a time. A long pre-token is cut into chunks
that step together, from the states that they may begin with; their state maps, which carry token counts, are composed by a
parallel prefix scan. The table is emptied when it holds about ``MOST_BYTES``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkwell.llm.bytewords import lean, slices_of
from inkwell.llm.pretoken import pretokens

LIMIT = 1024
#: About what a worker's states and transitions may take before they are dropped and compiled anew.
MOST_BYTES = 384 << 20
LONG = 2048  # bytes; longer pre-tokens are counted in chunks
CHUNK = 512
_ROUNDS = 32
_MACHINES: dict[str, Transducer] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others
    follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        plain = _byte_of_char()
        added = {t["content"] for t in told["added_tokens"]}
        self.added = [a.encode() for a in sorted(added, key=len, reverse=True)]
        vocabulary = {k: v for k, v in told["model"]["vocab"].items() if k not in added}
        self.bytes_of = {v: bytes(plain[c] for c in k) for k, v in vocabulary.items()}
        self.id_of_byte = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.grows = [True]
        for i, data in self.bytes_of.items():
            node = 0
            for b in data:
                self.grows[node] = True
                after = self.child.get(node << 8 | b)
                if after is None:
                    after = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = after
            self.token[node] = i
        self.forget()

    def forget(self) -> None:
        self.fits_known: dict[tuple[int, int], bool] = {}
        self.held = 0
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.used = 0
        self._room(1 << 16)

    def _room(self, size: int) -> None:
        self.mask, self.shift = size - 1, np.uint64(64 - (size.bit_length() - 1))
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.delta = np.zeros(size, np.int16)

    def encode(self, data: bytes) -> list[int]:
        """Merge by rank, the leftmost first: the definition that the transducer is compiled from."""
        ids = [self.id_of_byte[b] for b in data]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids[:-1], ids[1:], strict=True)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens (or, with before -1, the one) are the encoding of their bytes."""
        known = self.fits_known.get((before, token))
        if known is None:
            data = self.bytes_of[token]
            known = self.encode(data) == [token] if before < 0 else self.encode(self.bytes_of[before] + data) == [before, token]
            self.fits_known[before, token] = known
            self.held += 200
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte and the number of tokens that it adds."""
        reached, token, at = [], -1, 0
        for node, before, count in self.states[state]:
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            if token < 0 and self.token[after] >= 0 and self._fits(before, self.token[after]):
                token, at = self.token[after], count
            if self.grows[after]:
                reached.append((after, before, count))
        if token < 0:
            raise ValueError("the vocabulary has no token for a byte")
        new = (*((n, b, c - at - 1) for n, b, c in reached), (0, token, 0))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            self.held += 250 + 160 * len(new)  # tuples and integers
        return number, at + 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The table places of keys, -1 where there is none yet."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == keys, slot, -1)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            got = self.keys[slot]
            hit = got == keys[todo]
            out[todo[hit]] = slot[hit]
            go = ~hit & (got >= 0)
            todo, slot = todo[go], slot[go]
        return out

    def _insert(self, keys: np.ndarray, after: np.ndarray, delta: np.ndarray) -> None:
        if (self.used + len(keys)) * 2 > self.mask:
            old = self.keys >= 0
            keep = self.keys[old], self.next[old], self.delta[old]
            size = self.mask + 1
            while (self.used + len(keys)) * 3 > size:
                size *= 2
            self._room(size)
            self.used = 0
            self._insert(*keep)
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            at, first = np.unique(slot[todo][free], return_index=True)
            mine = todo[free][first]
            self.keys[at], self.next[at], self.delta[at] = keys[mine], after[mine], delta[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            todo = todo[rest[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.used += len(keys)

    def _step(self, state: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one byte each, and the tokens that it adds."""
        keys = state << 8 | data
        places = self._find(keys)
        missing = places < 0
        if missing.any():
            new = np.unique(keys[missing])
            made = [self._compile(key >> 8, key & 255) for key in new.tolist()]
            self._insert(new, np.array([x for x, _ in made], np.int32), np.array([d for _, d in made], np.int16))
            places = self._find(keys)
        return self.next[places].astype(np.int64), self.delta[places]

    def _walk(self, state: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after all bytes of each row of ``columns``, and the tokens that they add."""
        total = np.zeros(len(state), np.int64)
        for data in columns.T:
            state, delta = self._step(state, data)
            total += delta
        return state, total

    def _count_long(self, data: np.ndarray) -> int:
        """The number of tokens of one long pre-token."""
        rows = len(data) // CHUNK
        grid = data[: rows * CHUNK].reshape(rows, CHUNK)
        # A chunk may begin with what the end of the one before gives a fresh state, and with whatever the maps found so far end in.
        state, _ = self._walk(np.zeros(rows - 1, np.int64), grid[:-1, -64:])
        chunk, state = np.arange(rows), np.concatenate((np.zeros(1, np.int64), state))
        maps: dict[tuple[int, int], tuple[int, int]] = {}
        for _ in range(_ROUNDS):
            ends, counts = self._walk(state, grid[chunk])
            maps |= zip(zip(chunk.tolist(), state.tolist(), strict=True), zip(ends.tolist(), counts.tolist(), strict=True), strict=True)
            new = {(c + 1, e) for c, e in zip(chunk.tolist(), ends.tolist(), strict=True) if c + 1 < rows} - maps.keys()
            if not new:
                state, total = self._compose(maps, rows)
                break
            chunk, state = (np.array(x, np.int64) for x in zip(*sorted(new), strict=True))
        else:  # states that never meet: on from chunk to chunk
            state, total = 0, 0
            for c in range(rows):
                if (c, state) in maps:
                    state, n = maps[c, state]
                else:
                    ends, counts = self._walk(np.array([state]), grid[c : c + 1])
                    state, n = int(ends[0]), int(counts[0])
                total += n
        _, last = self._walk(np.array([state], np.int64), data[None, rows * CHUNK :])
        return total + int(last[0])

    @staticmethod
    def _compose(maps: dict[tuple[int, int], tuple[int, int]], rows: int) -> tuple[int, int]:
        """The state and count after all chunks from state 0, by a prefix scan over the chunks' state maps."""
        places: list[dict[int, int]] = [{} for _ in range(rows + 1)]
        for c, s in sorted(maps):
            places[c][s] = len(places[c])
        for (c, _), (end, _) in maps.items():
            if c == rows - 1:
                places[rows].setdefault(end, len(places[rows]))
        width = max(map(len, places))
        to, add = np.zeros((rows, width), np.int64), np.zeros((rows, width), np.int64)
        for (c, s), (end, n) in maps.items():
            to[c, places[c][s]], add[c, places[c][s]] = places[c + 1][end], n
        hop = 1
        while hop < rows:
            through = np.take_along_axis(to[hop:], to[:-hop], axis=1)
            add = np.concatenate((add[:hop], add[:-hop] + np.take_along_axis(add[hop:], to[:-hop], axis=1)))
            to = np.concatenate((to[:hop], through))
            hop *= 2
        first = places[0][0]
        return list(places[rows])[to[-1, first]], int(add[-1, first])

    def count(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token."""
        if self.held + 14 * len(self.keys) > MOST_BYTES:
            self.forget()
        out = np.zeros(len(sizes), np.int64)
        long = sizes > LONG
        for i in np.flatnonzero(long).tolist():
            out[i] = self._count_long(buffer[starts[i] : starts[i] + sizes[i]])
        short = np.flatnonzero(~long)
        order = short[np.argsort(-sizes[short], kind="stable")]
        at, sizes = starts[order], sizes[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
        for k, m in enumerate(live.tolist()):
            state[:m], delta = self._step(state[:m], buffer[at[:m] + k])
            total[:m] += delta
        out[order] = total
        return out

    def count_texts(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text; an added token inside a text is one token."""
        pieces, of, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = [t]
            for a in self.added:
                if a in t:
                    parts = [p for part in parts for p in part.split(a)]
            extra[i] = len(parts) - 1
            pieces += parts
            of += [i] * len(parts)
        buffer, starts, sizes, firsts = pretokens(pieces)
        upto = np.concatenate(([0], np.cumsum(self.count(buffer, starts, sizes), dtype=np.int64)))
        return extra + np.bincount(np.array(of, np.int64), weights=upto[firsts[1:]] - upto[firsts[:-1]], minlength=len(texts)).astype(np.int64)


def transducer(path: str) -> Transducer:
    """The worker's transducer for a vocabulary file, made once."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs``.

    ``path`` is a byte-level BPE file of the tokenizers library, there on every worker. Whole texts are counted; a null
    text is empty and has no tokens. Repeated rows repeat; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            for a, b, buffer, offsets in slices_of(batch.column("__text"), 4 << 20):
                flat = buffer.tobytes()
                counts = machine.count_texts([flat[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets)), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    schema = StructType([docs.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(lean(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
