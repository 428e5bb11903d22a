"""Token sequences of bounded length filled by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm import bpe, words
from seqlattice.session import materialize

CAPACITY = 4096
# Ordinals of one length are given out per length and salt, so pieces of one length are no hot group.
SALTS = 64

_LOWER_KEEPS = 0x3C  # '<' opens the literals of special tokens, which are matched before lower-casing.


def _word_ids(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of consecutive texts by a tokenizer that drops white space and lower-cases; where each text's begin.

    No token reaches over white space, so a text's ids are those of its words.
    """
    plain = words._LOWER[data]
    if (data == _LOWER_KEEPS).any():
        found = words.split(data, offsets)
        marks = np.flatnonzero(data == _LOWER_KEEPS)
        for k in np.unique(np.searchsorted(found.start, marks, "right") - 1):
            plain[found.start[k] : found.end[k]] = data[found.start[k] : found.end[k]]
    found = words.split(plain, offsets)
    start, end, owner = bpe.cut_tails(plain, found.start, found.end)
    sums = words.prefix_sums(plain)
    table = bpe.units(path)
    slots = table.lookup(plain, start, end, words.run_hash(sums, start, end))
    ids, first = table.gather(slots)
    begin = np.searchsorted(owner, found.first)
    return ids, first[begin]


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of each piece of at most ``capacity`` ids.

    A text's ids are the tokenizer's and ``end_id``; a null text counts as empty. Only longer ones are cut.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in words.pieces(batch.column(1)):
                ids, first = _word_ids(tokenizer, data, offsets)
                whole = np.insert(ids, first[1:], end_id).astype("<u4")
                bounds = first + np.arange(len(first))
                count = -(-np.diff(bounds) // capacity)
                text = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[text] - start, capacity)
                at = bounds[text] + start
                raw = memoryview(whole).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                columns = [batch.column(0).slice(row, len(count)).cast(pa.int64()).take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``capacity``, the longest length included.

    Bit ``s`` of a set says that a sum of ``s`` can be reached; a length that is there ``c`` times is added as
    1, 2, 4, .. copies. The sets after each step are kept to walk back from the largest sum.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        copies = 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a histogram of lengths: ``(lengths and copies in a bin, number of such bins)``.

    Each bin takes the longest length left and the fullest combination with it, which is then removed; the same
    combination is removed as often as it is there. The work depends on the number of different lengths
    (at most ``capacity``), not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        used = fullest(left, capacity)
        times = min(left[n] // k for n, k in used.items())
        out.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` ids, gapless from 0.

    ``pieces`` has ``length`` (1 to ``capacity``) and is read twice, so it should be a written table. The driver
    gets the number of pieces per length and salt (at most ``capacity * salts`` rows) and solves the
    packing on it. Pieces of one length are numbered within length and salt; a table of at most
    ``capacity`` bins' worth of rows says which numbers go to which sequences, and it is joined by length.
    An empty table gives an empty result; which of several equal pieces goes where is not defined.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keyed = pieces.select(*names, F.pmod(F.xxhash64(*names), F.lit(salts)).alias("__salt"))
    groups = sorted(tuple(r) for r in keyed.groupBy("length", "__salt").count().collect())
    counts: dict[int, int] = {}
    base = []
    for length, salt, n in groups:
        base.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    given, sequence, slots = {}, 0, []
    for used, times in patterns(counts, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            low = given.get(length, 0)
            slots.append((length, low, used[length], times, sequence, offset))
            given[length] = low + used[length] * times
            offset += length * used[length]
        sequence += times
    table: dict[int, list] = {}
    for slot in slots:
        table.setdefault(slot[0], []).append(slot[1:])
    ranges = {n: np.array(v, np.int64).reshape(-1, 5) for n, v in table.items()}
    starts = {(n, s): b for n, s, b in base}
    packed = spark.sparkContext.broadcast((starts, ranges))
    schema = packed_schema(keyed.drop("__salt"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ranges = packed.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            salt = batch.column(batch.schema.get_field_index("__salt")).to_numpy()
            number = batch.column(batch.schema.get_field_index("__number")).to_numpy() - 1
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.lexsort((salt, length))
            cuts = np.flatnonzero(np.diff(length[order]) | np.diff(salt[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                n = int(length[rows[0]])
                at = number[rows] + starts[n, int(salt[rows[0]])]
                low, _, times, sequence, offset = ranges[n][np.searchsorted(ranges[n][:, 0], at, "right") - 1].T
                seq[rows] = sequence + (at - low) % times
                off[rows] = offset + (at - low) // times * n
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    numbered = keyed.withColumn("__number", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(F.lit(0))))
    return numbered.mapInArrow(assign, schema)


def packed_schema(df: DataFrame) -> str:
    """A DDL schema: the columns of ``df``, then sequence and offset."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, "sequence_id bigint", "offset bigint"])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its ids' checksum and its place in a sequence.

    Null and empty texts are the end id alone. Rows are packed as they come: repeated rows and null ids are
    kept. Other columns are not read. The pieces are written out once, as packing reads them twice.
    """
    return pack(materialize(tokenize_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids)), capacity)
