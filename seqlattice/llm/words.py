"""Words of a column of texts as arrays: starts, ends, 64-bit hashes and owners.

The hash of a byte run is a difference of prefix sums, ``sum(code[b] * BASE**i)`` modulo 2**64, scaled
back to the run's start and mixed. Everything is array work on one piece of the column at a time; the
memory is about fifty bytes per byte of a piece, and a piece is ``PIECE`` bytes or one text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.table = np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = U64(pow(self.base, len(self.table), 2**64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


_UP = _Powers(_BASE)
_DOWN = _Powers(pow(_BASE, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Words(NamedTuple):
    """The words of ``texts`` consecutive texts: word ``first[t]`` to ``first[t + 1]`` belong to text ``t``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_CODE[data] * _UP.upto(len(data)), out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs ``start`` to ``end``."""
    return mix((sums[end] - sums[start]) * _DOWN.upto(len(sums))[start])


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts that ``offsets`` cuts out of ``data``; ``between`` marks other bytes that end words."""
    if lower:
        data = _LOWER[data]
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    space = between[data]
    opens = np.empty(len(data), bool)
    opens[0] = True
    opens[1:] = space[:-1]
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    closes = np.empty(len(data), bool)
    closes[-1] = True
    closes[:-1] = space[1:]
    closes[offsets[1:][offsets[1:] > 0] - 1] = True
    start = np.flatnonzero(~space & opens)
    end = np.flatnonzero(~space & closes) + 1
    return Words(data, start, end, run_hash(prefix_sums(data), start, end), np.searchsorted(start, offsets))


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets`` of successive pieces of a string column; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


# Rows whose texts are made ready together by ``few_pieces``.
ROWS = 1024


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def few_pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``pieces`` of ``ROWS`` rows at a time, as what makes them ready copies their texts; memory that is free then goes back to the system.

    A worker that is used for many stages otherwise keeps the most that any of them took.
    """
    for cut in range(0, len(texts), ROWS):
        for row, data, offsets in pieces(texts.slice(cut, ROWS), size):
            yield cut + row, data, offsets
    release()


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and where each text's begin; a shorter text gives one, of all its words."""
    h, count = words.hash, np.diff(words.first)
    wide = np.maximum(count - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(np.where(count > 0, np.maximum(wide, 1), 0))])
    out = np.zeros(first[-1], U64)
    short = np.flatnonzero((count > 0) & (count < size))
    base = np.repeat(words.first[:-1], wide) + _within(wide)
    total = np.zeros(len(base), U64)
    for k in range(size):
        total += mix(h[base + k] + U64(k + 1)) * U64(2 * k + 3)
    out[np.repeat(first[:-1], wide) + _within(wide)] = mix(total)
    for t in short:
        run = h[words.first[t] : words.first[t + 1]]
        k = np.arange(len(run), dtype=U64)
        out[first[t]] = mix(np.add.reduce(mix(run + k + U64(1)) * (U64(2) * k + U64(3)), keepdims=True) + np.full(1, len(run), U64) * U64(_BASE))[0]
    return out, first


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive runs."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def ragged(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the elements of ``rows`` in a ragged table with offsets ``first``, and where each row's begin."""
    counts = first[rows + 1] - first[rows]
    return np.repeat(first[rows], counts) + _within(counts), np.concatenate([[0], np.cumsum(counts)])
