"""Byte-level text helpers shared by the operators that scan text in Arrow batches.

Every character class used by the operators is defined on ASCII, and UTF-8
encodes all other characters with bytes >= 0x80, so scanning bytes is exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of rows that go through an operator at once, so that what it hands back is no larger batch.
SLICE_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse mod 2**64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes, and of a row at least."""
    for batch in batches:
        step = max(1, len(batch) * limit // max(batch.nbytes, limit))
        for at in range(0, max(len(batch), 1), step):
            yield batch.slice(at, step)


def release_memory() -> None:
    """Gives unused memory back to the system: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for ``mapInArrow`` that gets its rows in slices and leaves no unused memory behind."""

    @wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            release_memory()

    return outer


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = _byte_codes()
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; only those for a chunk are kept."""
    if len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size, made = max(n, CHUNK_BYTES + 4096), {}
    for key, base in (("up", _BASE), ("down", _BASE_INV)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made[key] = np.cumprod(steps, dtype=np.uint64)
    if n <= CHUNK_BYTES + 4096:
        _powers.update(made)
    return made["up"], made["down"]


#: True for bytes that belong to a word when words are split at white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32).astype(np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (byte positions) and each text's first word; words never cross texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[: len(data)] = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    cut = first[first < len(data)]
    begins = inside & ~before
    begins[cut] = inside[cut]
    stops = before & ~inside
    stops[cut] = before[cut]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial prefix sums mod 2**64, then a finaliser.

    Words come in order; about ``CHUNK_BYTES`` of them are hashed at once.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        piece, s, e = data[low : ends[stop - 1]], starts[at:stop] - low, ends[at:stop] - low
        up, down = power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_CODES[piece] * up[: len(piece)], out=sums[1:])
        out[at:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` word hashes (position i: words i .. i+width-1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= _BASE
        total += words[k : k + n]
    return mix64(total)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, concatenated."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
