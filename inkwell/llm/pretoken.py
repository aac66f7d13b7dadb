"""The pre-tokenizer of byte-level BPE as a deterministic finite-state transducer over character classes.

Contractions, letters, numbers, other characters (each with one leading space) and white space form
pre-tokens; of a run of white space before a word the last character goes to the word. That takes thirteen states.
A transition says whether a pre-token begins at the character read, or at the one before it.

A buffer of many texts is cut into equal chunks. Each chunk's state map (from each possible state at its
begin to that at its end) is computed for all chunks at once; a parallel prefix scan composes the maps, which
gives every chunk's true first state; one more pass then emits the boundaries.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, STMD, R, V, L_, E, END = range(12)
CLASSES = 12
(FRESH, IN_L, IN_N, IN_P, SP1, SPN, WS1, WSN, APOS, APOS_R, APOS_V, APOS_L, CLOSED) = range(13)
STATES = 13
HERE, BEFORE = 1, 2
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CHUNK = 128
_HEAD = 8


def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    table[_WHITE] = BLANK
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L_), ("e", E)):
        table[[ord(x) for x in chars]] = c
    return table


def _step(state: int, c: int) -> tuple[int, int]:
    letter = c in (LETTER, STMD, R, V, L_, E)
    if c == END:
        return FRESH, HERE | (BEFORE if state in (APOS_R, APOS_V, APOS_L) else 0)
    if state in (APOS_R, APOS_V, APOS_L):
        if (state, c) in ((APOS_R, E), (APOS_V, E), (APOS_L, L_)):
            return CLOSED, 0
        after, out = _step(IN_L, c)
        return after, out | BEFORE
    if state == APOS:
        if c == STMD:
            return CLOSED, 0
        if c in (R, V, L_):
            return {R: APOS_R, V: APOS_V, L_: APOS_L}[c], 0
        return _step(IN_P, c)
    if c in (SPACE, BLANK):
        if state in (SP1, SPN, WS1, WSN):
            return (SPN if c == SPACE else WSN), 0
        return (SP1 if c == SPACE else WS1), HERE
    kind = IN_L if letter else IN_N if c == NUMBER else IN_P
    if state in (SP1, SPN):
        return kind, BEFORE if state == SPN else 0
    if state == kind:
        return kind, 0
    return (APOS if c == QUOTE else kind), HERE | (BEFORE if state == WSN else 0)


_NEXT = np.array([_step(s, c)[0] for s in range(STATES) for c in range(CLASSES)], dtype=np.int16)
_OUT = np.array([_step(s, c)[1] for s in range(STATES) for c in range(CLASSES)], dtype=np.uint8)
_TABLE: list[np.ndarray] = []


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """State maps (rows) of first followed by second."""
    return np.take_along_axis(second, first.astype(np.intp), axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Row k: the composition of the maps 0 to k, in log steps over all rows at once."""
    maps, hop = maps.copy(), 1
    while hop < len(maps):
        maps[hop:] = compose(maps[:-hop], maps[hop:])
        hop *= 2
    return maps


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Flags of the positions at which a pre-token (or an END) begins."""
    n = len(classes)
    rows = -(-n // _CHUNK)
    padded = np.full(rows * _CHUNK, END, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(rows, _CHUNK).T).astype(np.int16)
    maps = np.tile(np.arange(STATES, dtype=np.int16), (rows, 1))
    for k in range(_HEAD):
        maps = _NEXT[maps * CLASSES + grid[k][:, None]]
    # Nearly all chunks have forgotten their first state by now and go on with one state.
    same = (maps == maps[:, :1]).all(axis=1)
    one, several = maps[:, 0].copy(), np.flatnonzero(~same)
    rest = maps[several]
    for k in range(_HEAD, _CHUNK):
        one = _NEXT[one * CLASSES + grid[k]]
        if len(several):
            rest = _NEXT[rest * CLASSES + grid[k][several][:, None]]
    maps = np.repeat(one[:, None], STATES, axis=1)
    maps[several] = rest
    ends = scan(maps)[:, FRESH]
    state = np.concatenate((np.array([FRESH], np.int16), ends[:-1]))
    out = np.empty((_CHUNK, rows), np.uint8)
    for k in range(_CHUNK):
        at = state * CLASSES + grid[k]
        out[k] = _OUT[at]
        state = _NEXT[at]
    out = out.T.reshape(-1)[:n]
    flags = (out & HERE).astype(bool)
    flags[:-1] |= (out[1:] & BEFORE).astype(bool)
    return flags


def pretokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of UTF-8 texts (with spare bytes), and the starts and sizes of their pre-tokens in order, and the
    first pre-token's number of each text (with the total at the end)."""
    if not _TABLE:
        _TABLE.append(_class_table())
    joined = b"\0".join([*texts, b""]) if texts else b""
    buffer = np.frombuffer(joined + bytes(16), np.uint8)
    solid = buffer[: len(joined)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    if len(joined) and solid.max() < 128:
        at, codes = None, solid
    else:
        at = np.flatnonzero((solid & 0xC0) != 0x80)
        codes = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), "<u4")
    classes = _TABLE[0][codes]
    marks = ends if at is None else np.searchsorted(at, ends)
    classes[marks] = END
    flags = boundaries(classes)
    begins = np.flatnonzero(flags)
    if at is not None:
        begins = at[begins]
    is_end = np.isin(begins, ends, assume_unique=True)
    sizes = np.diff(np.concatenate((begins, [len(joined)])))
    starts = begins[~is_end]
    firsts = np.concatenate((np.zeros(1, np.int64), np.searchsorted(starts, ends)))
    return buffer, starts, sizes[~is_end], firsts
