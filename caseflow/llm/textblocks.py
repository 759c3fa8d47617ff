"""Vectorised words and hashes over Arrow text columns.

A text column is walked in blocks of about `BLOCK` bytes, so that what is held per word stays small whatever the
Arrow batch holds; a longer document is a block of its own. Its bytes are marked by a few flags of one byte and hashed
in steps, also inside one long word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
# Bytes that are hashed at once.
STEP = 1 << 18

# Byte classes. Bytes over 0x7F belong to words everywhere.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers are kept, and would keep it too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need none
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of an unsigned 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS = _powers(_BASE, 256)


class Block(NamedTuple):
    """Rows lo..hi of a column: their bytes, and the byte bounds of every row."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of a block: byte ranges, 64-bit hashes, and the word bounds of every row."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def row_end(self) -> np.ndarray:
        return np.repeat(self.bounds[1:], np.diff(self.bounds))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield Block(lo, min(hi, n), raw[bounds[lo] : bounds[min(hi, n)]], bounds[lo : min(hi, n) + 1] - bounds[lo])
        lo = hi


def words(block: Block, member: np.ndarray, fold: np.ndarray) -> Words:
    """Maximal runs of `member` bytes after `fold`; a run never crosses a row."""
    folded = fold[block.data]
    inside = member[folded]
    n = len(folded)
    if not n or not inside.any():
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(block.bounds), np.int64))
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = block.bounds[(block.bounds > 0) & (block.bounds < n)]
    before[edges] = False
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    del before, after
    return Words(start, end, _word_hashes(folded, start, end), np.searchsorted(start, block.bounds).astype(np.int64))


def _word_hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = STEP) -> np.ndarray:
    """Hashes of byte ranges, about `step` bytes at a time, so that a long text takes no 64-bit value per byte."""
    length = end - start
    upto = np.cumsum(length)
    found = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        done = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + step, "right")))
        if length[lo] > step:
            found[lo] = _long_word(folded[start[lo] : end[lo]], step)
            lo += 1
            continue
        own = length[lo:hi]
        powers = _POWERS if own.max() <= len(_POWERS) else _powers(_BASE, int(own.max()))
        first = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        values = _BYTE_VALUES[folded[np.repeat(start[lo:hi], own) + place]]
        found[lo:hi] = np.add.reduceat(values * powers[place], first)
        lo = hi
    return mix(found + length.astype(np.uint64))


def _long_word(data: np.ndarray, step: int) -> np.uint64:
    """The sum of _word_hashes() for one word of more than `step` bytes."""
    total, factor, powers = np.uint64(0), np.uint64(1), _powers(_BASE, step)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), step):
            part = data[at : at + step]
            total += factor * (_BYTE_VALUES[part] * powers[: len(part)]).sum(dtype=np.uint64)
            factor *= powers[-1] * np.uint64(_BASE)
    return total


def rolling_words(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of code points."""
    if not len(start):
        return np.zeros(0, np.uint64)
    powers = _POWERS if length.max() <= len(_POWERS) else _powers(_BASE, int(length.max()))
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    values = mix(points[np.repeat(start, length) + place].astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(values * powers[place], first) + length.astype(np.uint64))


def rolling(hashes: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64) of every `width` consecutive values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, width):
        acc *= np.uint64(base)
        acc += hashes[j : n + j]
    return acc


def window_starts(w: Words, width: int) -> np.ndarray:
    """Mask over rolling(): windows that stay inside their row."""
    n = max(len(w.hashes) - width + 1, 0)
    return np.arange(n) + width <= w.row_end()[:n]
