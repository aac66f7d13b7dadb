"""Batch encoding with a byte-level BPE vocabulary of the tokenizers library.

A text's ids are those of its pre-tokens one after another, so each worker calls the library for the pre-tokens it has
not met before only, and takes the others from sorted arrays of hashes. The arrays are emptied beyond
``MEMORY`` pre-tokens. Texts that hold one of the vocabulary's added tokens go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from inkwell.llm.bytewords import hash_slices
from inkwell.llm.pretoken import pretokens

MEMORY = 1_500_000
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)

    def _call(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > MEMORY:
            self.forget()
        sizes, flat = [], [self.ids]
        for k in range(0, len(texts), 4_000):
            made = self._call(texts[k : k + 4_000])
            sizes.append(np.fromiter(map(len, made), np.uint32, len(made)))
            flat.append(np.fromiter((x for ids in made for x in ids), self.ids.dtype, int(sizes[-1].sum())))
        counts = np.concatenate(sizes)
        at = (np.cumsum(counts, dtype=np.int64) - counts + len(self.ids)).astype(np.uint32)
        self.ids = np.concatenate(flat)
        keys, at, counts = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.counts, counts)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.counts = keys[order], at[order], counts[order]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = places < len(self.keys)
        known[inside] = self.keys[places[inside]] == keys[inside]
        return places, known

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of each text's ids."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if whole:
            rest = list(texts)
            for i in whole:
                rest[i] = b""
            ids, counts = self.encode(rest)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, got in zip(whole, self._call([texts[i].decode() for i in whole]), strict=True):
                parts[i] = np.array(got, np.uint32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        buffer, starts, sizes, firsts = pretokens(texts)
        keys, first, inverse = np.unique(hash_slices(buffer, starts, sizes), return_index=True, return_inverse=True)
        if not len(keys):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        places, known = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            flat = buffer.tobytes()
            words = [flat[a : a + n].decode() for a, n in zip(starts[first[new]].tolist(), sizes[first[new]].tolist(), strict=True)]
            if len(self.keys) + len(new) > MEMORY:  # the batch's own known words must stay
                self.forget()
                new, words = np.arange(len(keys)), [flat[a : a + n].decode() for a, n in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)]
            self._learn(keys[new], words)
            places, _ = self._find(keys)
        counts = self.counts[places][inverse].astype(np.int64)
        begin = self.at[places][inverse].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1])
        ids = self.ids[np.repeat(begin - (ends - counts), counts) + np.arange(total)].astype(np.uint32)
        upto = np.concatenate((np.zeros(1, np.int64), ends))
        return ids, upto[firsts[1:]] - upto[firsts[:-1]]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
