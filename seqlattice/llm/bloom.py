"""Bloom filters of bounded size, filled by tasks and broadcast: what they do not hold can be passed by without a shuffle.

There are no false negatives. A filter has 16 bits for each member up to ``BITS``; beyond that it lets more through, so a
caller needs an exact way for what passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqlattice.llm.words import U64

# Largest filter in bits (32 MB), probes of a member, and bits that travel in one row.
BITS = 1 << 28
PROBES = 4
CHUNK = 1 << 16


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> U64(32)) | U64(1)
    for k in range(PROBES):
        yield (h + U64(k) * step) & U64(bits - 1)


def contains(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be members."""
    out = np.ones(len(h), bool)
    for place in _places(h, len(bloom) * 8):
        out &= (bloom[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def build(members: DataFrame, count: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The filter of ``count`` rows, whose well-mixed 64-bit hashes ``hashes`` gives, as bytes."""
    bits = min(max(1 << (16 * count).bit_length(), CHUNK), BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(list(_places(hashes(batch), bits))))
            cuts = np.flatnonzero(np.diff(found // U64(CHUNK))) + 1
            for part in np.split(found, cuts) if len(found) else []:
                yield pa.RecordBatch.from_arrays([pa.array([int(part[0]) // CHUNK]), pa.array([(part % U64(CHUNK)).astype(np.uint16).tobytes()], pa.binary())], ["chunk", "places"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(CHUNK, np.uint8)
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                marked[np.frombuffer(raw, np.uint16)] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(marked, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for chunk, raw in members.mapInArrow(places, "chunk long, places binary").groupBy("chunk").applyInArrow(merge, "chunk long, bits binary").collect():
        out[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(raw, np.uint8)
    return out
