"""Vectorised handling of many short byte strings inside one buffer."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles

from inkwell.session import local_path

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
PAD = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lean(run):
    """``run`` over batches, after which the worker gives the memory that it no longer uses back to the machine; workers live on for other
    stages, and what they once needed would add up."""

    @functools.wraps(run)
    def go(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return go


def hash_slices(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of buffer[start : start + size]. The buffer ends with PAD spare bytes. Strings of up to seven
    bytes never collide with each other; longer ones do with the odds of a random 64-bit function."""
    lanes = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    x = lanes[starts] & _MASKS[np.minimum(sizes, 8)]
    x |= np.where(sizes < 8, sizes, 0).astype(np.uint64) << np.uint64(56)
    h = mix(x)
    rest = np.flatnonzero(sizes >= 8)
    at = 8
    while len(rest):
        size = sizes[rest]
        v = lanes[starts[rest] + at] & _MASKS[np.minimum(size - at, 8)]
        h[rest] = mix((h[rest] ^ v) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        at += 8
        rest = rest[size >= at]
    return h


def slices_of(column: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most_bytes`` of text (a longer text stands alone): first row, end row, their bytes with
    PAD spare ones, and the offsets of the rows in them. Nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        end = min(end, n)
        part = data[offsets[first] : offsets[end]]
        yield first, end, np.concatenate((part, np.zeros(PAD, np.uint8))), offsets[first : end + 1] - offsets[first]
        first = end


def words_of(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and sizes of the words [^\\x20\\x09-\\x0D]+ of each row, and the first word's number of each row (with the
    total at the end)."""
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[buffer[:n]]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, offsets)


def lower_ascii(buffer: np.ndarray) -> np.ndarray:
    """A-Z to lower case; other bytes, those of multi-byte characters included, stay."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer + 32, buffer).astype(np.uint8)


def run_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i] : firsts[i + 1]]."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[firsts[1:]] - total[firsts[:-1]]


def open_out(folder: str, name: str):
    """A stream to a new file of a shared folder (any scheme that pyarrow knows) and its URL. Each attempt of a task
    gets a name of its own, so that a repeated task never touches another's file."""
    url = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"
    system, path = fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path), url


def open_in(url: str):
    """A stream over a file of a shared folder."""
    system, path = fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)
    return system.open_input_stream(path)


def mapped(url: str) -> np.ndarray:
    """The bytes of a file of a shared folder, mapped. A file of a store without paths is copied, once for all workers of a machine, to the
    folder that Spark keeps there for this application and deletes with it."""
    path = local_path(url)
    if path is None:
        path = os.path.join(SparkFiles.getRootDirectory(), "inkwell-" + uuid.uuid5(uuid.NAMESPACE_URL, url).hex)
        if not os.path.exists(path):
            part = f"{path}-{uuid.uuid4().hex[:10]}"
            with open_in(url) as source, open(part, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            os.replace(part, path)  # of two workers that copy at once the later wins, with equal bytes
    return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)


def read_all(url: str) -> bytes:
    with open_in(url) as stream:
        return stream.read()
