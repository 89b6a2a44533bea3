"""Array work on the UTF-8 bytes of many texts at once, inside tasks.

Texts reach a task as Arrow batches. A batch is handled in pieces of bounded
size, and every function here works on one piece: ``data`` holds the bytes of
its texts end to end, ``offsets`` where each text starts (and the last ends).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Any fixed odd multiplier will do; MIX holds the usual 64-bit finaliser constants.
BASE = 0x9E3779B97F4A7C15
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
BYTE_VALUES = np.random.Generator(np.random.PCG64(20_011)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[str, np.ndarray] = {}
_kept: dict[tuple, object] = {}
_owner: list[str] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= MIX[0]
    h ^= h >> np.uint64(33)
    h *= MIX[1]
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 4096)
        for name, step in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            each = np.full(size, step, np.uint64)
            each[0] = 1
            _powers[name] = np.cumprod(each)
    return _powers["up"], _powers["down"]


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def keep(key: tuple, make):
    """What ``make`` gives, kept in this process for the next tasks of the same operator; one value at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def claim(operator: str) -> None:
    """Drop what another operator kept."""
    if _owner != [operator]:
        _kept.clear()
        _owner[:] = [operator]


def task(function):
    """For functions over the batches of a task: processes live on between tasks, but keep no memory they don't need."""

    @functools.wraps(function)
    def run(batches):
        claim(function.__module__)
        try:
            yield from function(batches)
        finally:
            release()

    return run


def as_text(column: pa.Array) -> pa.Array:
    """The column as text with 64-bit offsets, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array, without copying."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch of texts into (first row, end row, data, offsets) of at most ``limit`` bytes or one row."""
    data, offsets = buffers(texts)
    row, rows = 0, len(texts)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words (runs without white space) of a piece: byte range and text of each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of all words


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of ``inside`` that stay within one text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    start, end = runs(~SPACE[data], offsets)
    first = np.searchsorted(start, offsets, "left")
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, doc, first)


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running sums from which the hash of any byte range follows."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, the same wherever the bytes stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def hash_text(text: str, table: np.ndarray = BYTE_VALUES) -> int:
    """The hash that ``range_hash`` gives for these bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(range_hash(prefix_hash(data, table), np.array([0]), np.array([len(data)]))[0])


def count_in(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of set flags in each range."""
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=sums[1:], dtype=np.int32)
    return sums[end] - sums[start]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words with the text of each; a text of fewer words has one of all its words."""
    found = words(data, offsets)
    each = range_hash(prefix_hash(data), found.start, found.end)
    counts = np.diff(found.first)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    first = np.concatenate([np.arange(a, b - n + 1) if b - a >= n else np.arange(a, min(a + 1, b)) for a, b in zip(found.first[:-1], found.first[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), np.where(counts >= n, counts - n + 1, np.minimum(counts, 1)))
    left = found.first[doc + 1] - first
    total = np.zeros(len(first), np.uint64)
    for j in range(n):
        inside = left > j
        at = np.minimum(first + j, max(len(each) - 1, 0))
        total += np.where(inside, each[at] * factors[j], np.uint64(0)) if len(each) else np.uint64(0)
    return mix(total), doc
