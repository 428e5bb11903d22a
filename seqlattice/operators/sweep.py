"""Range joins over sorted coordinates, without bins.

Points and the two ends of every interval are range-partitioned by coordinate. An interval belongs to the slice it starts in, and is
carried on to each slice up to that of its end; it is repeated once for each slice it spans, whatever its length. In a slice the
points lie sorted, and those inside an interval are one run of them, found by two binary searches. Work and memory follow the points,
the intervals that touch a slice, and the pairs that come out. Points at one crowded coordinate are spread by a hash, as the ends of intervals
sort before and after all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqlattice.operators.ordering import SLICE, slice_rows
from seqlattice.session import materialize


def codes(left: Sequence[pa.Array], right: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the keys of two tables, equal for equal keys; -1 where a key is null."""
    n = len(left[0])
    total, missing = np.zeros(n + len(right[0]), np.int64), np.zeros(n + len(right[0]), bool)
    for a, b in zip(left, right, strict=True):
        both = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
        index = pc.fill_null(both.indices, -1).to_numpy().astype(np.int64)
        missing |= index < 0
        total = np.unique(total * (len(both.dictionary) + 1) + index, return_inverse=True)[1]
    total[missing] = -1
    return total[:n], total[n:]


def hits(point_key: np.ndarray, position: np.ndarray, interval_key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the points and of the closed intervals of each pair in which the point lies in the interval; keys below zero match nothing."""
    if not len(position) or not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = int(position.min()), int(position.max())
    span = high - low + 1
    order = np.lexsort((position, point_key))
    place = point_key[order] * span + (position[order] - low)
    first = np.searchsorted(place, interval_key * span + (np.clip(start, low, high + 1) - low))
    after = np.searchsorted(place, interval_key * span + (np.clip(end, low - 1, high) - low), "right")
    count = np.where((interval_key >= 0) & (start <= end) & (start <= high) & (end >= low), np.maximum(after - first, 0), 0)
    interval = np.repeat(np.arange(len(start)), count)
    point = order[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    return point, interval


def overlaps(span_key: np.ndarray, begin: np.ndarray, stop: np.ndarray, interval_key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of closed intervals that overlap: the later of both starts lies in the other one."""
    fine = begin <= stop
    a, b = hits(np.where(fine, span_key, -1), begin, interval_key, start, end)
    c, d = hits(np.where(start <= end, interval_key, -1), start, span_key, begin + 1, stop)
    return np.concatenate([a, d]), np.concatenate([b, c])


def sweep_join(points: DataFrame, intervals: DataFrame, on: Sequence[str] = ("chrom",), position: str = "pos", start: str = "start", end: str = "end", how: str = "inner") -> DataFrame:
    """Points with the closed intervals they lie in: the columns of ``points``, then those of ``intervals`` but ``on``.

    ``how`` is ``inner`` or ``left``. Null keys and coordinates match nothing. Both tables may be of any size; the rows of each are
    written once.
    """
    on = list(on)
    given = intervals.select(*on, F.struct(*[c for c in intervals.columns if c not in on]).alias("_interval"), F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to"))
    given = materialize(given.filter(F.col("_from") <= F.col("_to")).withColumn("_number", F.monotonically_increasing_id()))
    row = F.struct(*[F.col(c) for c in points.columns]).alias("_point")

    def event(table: DataFrame, at: Column, kind: int, **more: Column) -> DataFrame:
        return table.select(*on, at.alias("_at"), F.lit(kind).alias("_kind"), *[v.alias(k) for k, v in more.items()])

    hashed = [F.col(f.name) for f in points.schema.fields if "map" not in f.dataType.simpleString()]
    events = event(points, F.col(position).cast("long"), 1, _salt=F.xxhash64(*hashed), _point=row)
    events = events.unionByName(event(given, F.col("_from"), 0, _salt=F.col("_number"), _number=F.col("_number"), _interval=F.col("_interval"), _to=F.col("_to")), allowMissingColumns=True)
    events = events.unionByName(event(given, F.col("_to"), 2, _salt=F.col("_number"), _number=F.col("_number")), allowMissingColumns=True)
    sliced = slice_rows(events, on, ["_at", "_kind", "_salt"])

    ends = sliced.filter("_kind = 2").select("_number", F.col(SLICE).alias("_last"))
    opened = sliced.filter("_kind = 0").join(ends, "_number")
    opened = opened.select(F.explode(F.sequence(SLICE, "_last")).alias(SLICE), *on, F.col("_at").alias("_from"), "_to", "_interval")
    placed = sliced.filter("_kind = 1").select(SLICE, *on, "_at", "_point")

    # Both sides come from one table, so their columns get new names before they are brought together.
    keys = [f"_on{k}" for k in range(len(on))]
    placed, opened = placed.toDF("_slice_p", *keys, "_at", "_point"), opened.toDF("_slice_i", *keys, "_from", "_to", "_interval")

    extra = given.schema["_interval"].dataType.fields
    schema = StructType([*points.schema.fields, *extra])
    left = how == "left"

    def pair(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = codes([mine[c].combine_chunks() for c in keys], [theirs[c].combine_chunks() for c in keys])
        at = mine["_at"]
        a[at.is_null().to_numpy()] = -1
        number = [pc.fill_null(t[c], 0).to_numpy().astype(np.int64) for t, c in ((mine, "_at"), (theirs, "_from"), (theirs, "_to"))]
        point, interval = hits(a, number[0], b, number[1], number[2])
        which = pa.array(interval)
        if left:
            alone = np.setdiff1d(np.arange(mine.num_rows), point)
            point = np.concatenate([point, alone])
            which = pa.concat_arrays([which, pa.nulls(len(alone), pa.int64())])
        columns = _fields(mine["_point"].take(pa.array(point))) + _fields(theirs["_interval"].take(which))
        return pa.table(columns, names=[f.name for f in schema.fields])

    return placed.groupBy("_slice_p").cogroup(opened.groupBy("_slice_i")).applyInArrow(pair, schema)


def _fields(rows: pa.ChunkedArray) -> list[pa.Array]:
    rows = rows.combine_chunks()
    return list(rows.flatten())


def sweep_overlaps(spans: DataFrame, intervals: DataFrame, on: Sequence[str] = ("chrom",), span: tuple[str, str] = ("from", "to"), interval: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of overlapping closed intervals, each once: the start of the later one is a point in the other."""
    begin = spans.filter(F.col(span[0]) <= F.col(span[1]))
    inside = sweep_join(begin, intervals, on, span[0], *interval)
    others = [c for c in intervals.columns if c not in on]
    wide = spans.withColumn("_after", F.col(span[0]) + 1)
    around = sweep_join(intervals.filter(F.col(interval[0]) <= F.col(interval[1])), wide, on, interval[0], "_after", span[1])
    return inside.unionByName(around.select(*spans.columns, *others))


def block_extremes(chrom: Column, blocks: Column, intervals: DataFrame, value: str) -> Column:
    """The smallest and largest ``value``, a number or text, of the intervals (``chrom, start, end``) that overlap any of a row's ``blocks``, as ``low`` and ``high``.

    ``intervals`` goes to all tasks, so the caller must have checked its size; rows are neither moved nor repeated.
    """
    table = intervals.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(value).alias("value"))
    found = table.filter("start <= end AND value IS NOT NULL AND chrom IS NOT NULL").toArrow().combine_chunks()
    contigs, values = (pa.array(found[c].to_pylist(), found.schema.field(c).type) for c in ("chrom", "value"))
    names = values.unique()
    names = names.take(pc.array_sort_indices(names))
    rank = pc.index_in(values, names).to_numpy(zero_copy_only=False).astype(np.int64)
    sent = intervals.sparkSession.sparkContext.broadcast((contigs, found["start"].to_numpy(), found["end"].to_numpy(), rank, names))
    kind = table.schema["value"].dataType

    @F.arrow_udf(StructType().add("low", kind).add("high", kind))
    def extremes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        contig, start, end, rank, names = sent.value
        for chroms, lists in batches:
            row = pc.list_parent_indices(lists).to_numpy()
            flat = pc.list_flatten(lists)
            begin, stop = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            a, b = codes([chroms.take(pa.array(row))], [contig]) if len(row) and len(contig) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            low, high = np.full(len(lists), len(names)), np.full(len(lists), -1)
            if len(a) and len(b):
                block, hit = overlaps(a, begin, stop, b, start, end)
                np.minimum.at(low, row[block], rank[hit])
                np.maximum.at(high, row[block], rank[hit])
            none = high < 0
            pick = [names.take(pa.array(v, mask=none)) for v in (low, high)]
            yield pa.StructArray.from_arrays(pick, ["low", "high"])

    return extremes(chrom, blocks)
