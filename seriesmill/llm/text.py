"""Vectorised words of Arrow string columns.

A text column is read through its UTF-8 buffer: numpy finds the word borders of
a whole block of rows at once and gives each word a 64-bit hash of its bytes.
Nothing is decoded, so the cost is a few nanoseconds a byte. Blocks hold whole
rows of about ``BLOCK_BYTES``, which bounds memory whatever the batch size is; a
single longer text makes a block of its own.

Two words with one hash are taken as equal. With random 64-bit byte codes the
chance of that is about 1e-5 for a vocabulary of ten million words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_RATE = np.uint64(0x9E3779B97F4A7C15 & ~0b100 | 0b11)  # odd, 3 mod 8: powers differ in high bits
_RATE_INVERSE = np.uint64(pow(int(_RATE), -1, 1 << 64))
_CODES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true in the inclusive ranges."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: What separates words, by contract.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """Rows ``first`` to ``first + rows`` of a batch: their bytes and row borders."""

    first: int
    rows: int
    data: np.ndarray
    ends: np.ndarray  # rows + 1 offsets into data
    null: np.ndarray  # rows flags


@dataclass
class Words:
    """Words of a block in order: byte borders, row of each, hash, and border of each row's words."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # rows + 1 offsets into the words
    data: np.ndarray  # the bytes, lower-cased if that was asked for

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole rows. A null row has no bytes."""
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Block(at, to - at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], null[at:to])
        at = to


class SliceHash:
    """Hashes of slices of one text; where a slice lies doesn't matter."""

    def __init__(self, data: np.ndarray):
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_CODES[data] * powers(_RATE, len(data)), out=self.sums[1:])
        self.back = powers(_RATE_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        size = length.astype(np.uint64) if isinstance(length, np.ndarray) else np.uint64(length)
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + size)


def slice_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair of borders."""
    return SliceHash(data)(start, end - start)


def words(block: Block, separators: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of bytes that are no separators, never across rows."""
    data = LOWER[block.data] if lower else block.data
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separators[data], out=inside[1:-1])
    border = np.zeros(len(data) + 1, bool)  # a row begins here
    border[block.ends] = True
    starts = inside[1:] & (~inside[:-1] | border)
    stops = inside[:-1] & (~inside[1:] | border)
    start, end = np.flatnonzero(starts), np.flatnonzero(stops)
    first = np.searchsorted(start, block.ends).astype(np.int64)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(start, end, row, slice_hash(data, start, end), first, data)


def windows_hash(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive words (len - size + 1 of them)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out ^ word_hash[i : i + n]) + np.uint64(0x9E3779B97F4A7C15)
    return out


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, as hashes sorted in the row, and each row's offsets.

    A row of fewer than ``size`` words, but not none, has one shingle: all its words.
    """
    count = np.diff(w.first)
    rows = len(count)
    hashes = windows_hash(w.hash, size)
    whole = w.row[: len(hashes)] == w.row[size - 1 :] if len(hashes) else np.zeros(0, bool)
    row, value = w.row[: len(hashes)][whole], hashes[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        brief = np.empty(len(short), np.uint64)
        for k, r in enumerate(short):
            brief[k] = windows_hash(w.hash[w.first[r] : w.first[r + 1]], int(count[r]))[0] + count[r].astype(np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, brief])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    return value, np.searchsorted(row, np.arange(rows + 1))


def release() -> None:
    """Gives memory that a task no longer uses back to the system, as its worker stays for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
