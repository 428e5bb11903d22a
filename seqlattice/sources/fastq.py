"""FASTQ readers that split plain files into byte ranges.

A first pass finds the first record of each range and counts the records from there on, in blocks. Sums over the blocks of a file
say which record each block begins with, so records have their numbers and the mates of a range of one file are found in the other,
whatever the lengths of its lines. No line is shuffled. Compressed files are read whole, each by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlattice.contracts import expect, expect_rows, lines_rule
from seqlattice.session import materialize
from seqlattice.sources.listing import absolute, store

# Bytes of a plain file that one task reads, and about as many as it holds.
SPLIT = 64 << 20
READ = 4 << 20

_READS = "ordinal BIGINT, read_id STRING, seq STRING, qual STRING"
_PAIRS = "ordinal BIGINT, read_id STRING, seq1 STRING, qual1 STRING, seq2 STRING, qual2 STRING"


# Endings of compressed files.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".br", ".snappy")


def is_plain(path: str) -> bool:
    return not path.endswith(COMPRESSED)


def _plain_path(column: str) -> Column:
    return ~reduce(lambda a, b: a | b, [F.col(column).endswith(e) for e in COMPRESSED])


def _absolute(column: str) -> Column:
    path = F.col(column)
    return F.when(path.startswith("/") | path.contains("://") | path.startswith("file:"), path).otherwise(F.concat(F.lit(absolute("").rstrip("/") + "/"), path))


def record_start(handle: pa.NativeFile, size: int, at: int) -> int:
    """The first byte from ``at`` on where a record begins, ``size`` if there is none.

    A quality line may begin with ``@`` as well, but the line after next is then a sequence, which never begins with ``+``.
    """
    if not at:
        return 0
    reach = 4096
    while True:
        handle.seek(at - 1)
        data = handle.read(reach)
        ended = at - 1 + len(data) >= size
        lines = data.split(b"\n")
        place = at - 1 + len(lines[0]) + 1
        # The last line counts if it is whole or if its first byte is there, which is all that is asked of it.
        for k in range(1, len(lines) - 2):
            if lines[k][:1] == b"@" and lines[k + 2][:1] == b"+":
                return place
            place += len(lines[k]) + 1
        if ended:
            return size
        reach *= 4


def record_blocks(handle: pa.NativeFile, at: int = 0) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Whole records from byte ``at`` on, their line ends and the place of the first; about ``READ`` bytes at a time."""
    held = b""
    while True:
        chunk = handle.read(max(READ, len(held)))
        data = held + chunk
        if not chunk and data and not data.endswith(b"\n"):
            data += b"\n"
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        count = len(ends) // 4
        if count:
            cut = int(ends[4 * count - 1]) + 1
            yield data[:cut], ends[: 4 * count], at
            data, at = data[cut:], at + cut
        if not chunk:
            if data:
                raise ValueError("A FASTQ file ends inside a record")
            return
        held = data


def parsed(data: bytes, ends: np.ndarray) -> pa.Table:
    """``header, seq, qual`` of whole records; the ``@`` is left out."""
    offsets = pa.py_buffer(np.concatenate([[0], ends + 1]).astype(np.int64).tobytes())
    lines = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(data)]).cast(pa.large_string())
    lines = pc.ascii_rtrim_whitespace(lines)
    header, seq, plus, qual = (lines.take(pa.array(np.arange(k, len(ends), 4))) for k in range(4))
    for part, mark in ((header, "@"), (plus, "+")):
        bad = pc.index(pc.starts_with(part, mark), False).as_py()
        if bad >= 0:
            raise ValueError(f"Line {1 if mark == '@' else 3} of a FASTQ record lacks its '{mark}': {header[bad]}")
    bad = pc.index(pc.equal(pc.binary_length(seq), pc.binary_length(qual)), False).as_py()
    if bad >= 0:
        raise ValueError(f"Bases and qualities differ in number: {header[bad]}")
    columns = [pc.utf8_slice_codeunits(header, 1), seq, qual]
    return pa.table([c.cast(pa.string()) for c in columns], names=["header", "seq", "qual"])


def records(path: str, at: int = 0, skip: int = 0, count: int | None = None) -> Iterator[pa.Table]:
    """``count`` records from the one after ``skip`` others on, which are counted from byte ``at``; all if ``count`` is None."""
    if count == 0:
        return
    system, inner = store(path)
    with system.open_input_file(inner) if is_plain(path) else system.open_input_stream(inner, compression="detect") as handle:
        if at:
            handle.seek(at)
        for data, ends, _ in record_blocks(handle, at):
            n = len(ends) // 4
            if skip >= n:
                skip -= n
                continue
            low, high = skip, n if count is None else min(n, skip + count)
            first = int(ends[4 * low - 1]) + 1 if low else 0
            yield parsed(data[first : int(ends[4 * high - 1]) + 1], ends[4 * low : 4 * high] - first)
            skip = 0
            if count is not None:
                count -= high - low
                if not count:
                    return


def plain_ids(headers: pa.ChunkedArray) -> pa.ChunkedArray:
    """Names up to the first white space, without ``/1`` or ``/2``."""
    return pc.replace_substring_regex(headers, r"^\s*(\S*?)(?:/[12])?(?:\s.*)?$", r"\1")


def together(left: Iterator[pa.Table], right: Iterator[pa.Table], what: str) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Records of both sides in tables of equal lengths."""
    one = two = None
    while True:
        one = one if one is not None and one.num_rows else next(left, None)
        two = two if two is not None and two.num_rows else next(right, None)
        if one is None or two is None:
            if one is not two:
                raise ValueError(f"Mate files of {what} have different numbers of records")
            return
        n = min(one.num_rows, two.num_rows)
        yield one.slice(0, n), two.slice(0, n)
        one, two = one.slice(n), two.slice(n)


def _with_sizes(files: DataFrame, split: int) -> DataFrame:
    """A row for each byte range of the plain ones among ``files`` (``path``), with ``start, stop, size``; tasks ask the store for sizes."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, inner = store(path)
                found.append(system.get_file_info(inner).size if is_plain(path) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["path", "size"])

    known = files.select("path").distinct().mapInArrow(sizes, "path STRING, size BIGINT").filter("size > 0")
    ranges = known.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    return ranges.select("path", "start", F.least(F.col("start") + split, "size").alias("stop"), "size")


def _spread(rows: DataFrame) -> DataFrame:
    """A written table with a task for each of its rows."""
    rows = materialize(rows)
    return rows.repartition(max(rows.count(), 1))


def index_records(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """``path, start, byte, records, before``: blocks of the plain files of ``files`` (``path``), in byte ranges that begin at ``start``.

    A block has ``records`` records from ``byte`` on; ``before`` others come before it in its file.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = store(path)
                found = []
                with system.open_input_file(inner) as handle:
                    at = record_start(handle, size, start)
                    handle.seek(at)
                    for _, ends, place in record_blocks(handle, at) if at < stop else ():
                        heads = place + np.concatenate([[0], ends[3:-1:4] + 1])
                        inside = int(np.searchsorted(heads, stop))
                        if inside:
                            found.append((place, inside))
                        if inside < len(heads):
                            break
                byte, number = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([start] * len(found), pa.int64()), pa.array(byte, pa.int64()), pa.array(number, pa.int64())], ["path", "start", "byte", "records"])

    blocks = materialize(_spread(_with_sizes(files, split)).mapInArrow(count, "path STRING, start BIGINT, byte BIGINT, records BIGINT"))
    earlier = Window.partitionBy("path").orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum("records").over(earlier), F.lit(0)))


def _ranges(blocks: DataFrame, *by: str) -> DataFrame:
    return blocks.groupBy(*by, "path", "start").agg(F.min("byte").alias("byte"), F.min("before").alias("before"), F.sum("records").alias("records"))


def read_fastq(spark: SparkSession, paths: Sequence[str], split: int = SPLIT) -> DataFrame:
    """``file, ordinal, read_id, seq, qual`` with the raw header as ``read_id``; ``file`` is the path as given, or made absolute."""
    files = spark.createDataFrame([(absolute(p),) for p in paths], "path STRING")
    return _read(files, split)


def _read(files: DataFrame, split: int) -> DataFrame:
    whole = files.select("path").distinct().filter(~_plain_path("path"))
    units = _ranges(index_records(files, split)).select("path", "byte", "before", "records")
    nothing = [F.lit(0).cast("long").alias(c) for c in ("byte", "before")]
    units = units.unionByName(whole.select("path", *nothing, F.lit(None).cast("long").alias("records")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, before, count in zip(*(c.to_pylist() for c in batch.columns)):
                for found in records(path, at, 0, count):
                    number = pa.array(np.arange(before + 1, before + 1 + found.num_rows))
                    before += found.num_rows
                    name = pa.array([path]).take(pa.array(np.zeros(found.num_rows, np.int64)))
                    yield from pa.table([name, number, *found.columns], names=["file", "ordinal", "read_id", "seq", "qual"]).combine_chunks().to_batches()

    return _spread(units).mapInArrow(read, f"file STRING, {_READS}")


def read_fastq_text(spark: SparkSession, paths: str | Sequence[str], split: int = SPLIT) -> DataFrame:
    """The table of ``read_fastq`` for files that Spark lists: folders and patterns in a path are followed."""
    listed = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return _read(listed.filter("length > 0").select("path"), split)


def read_fastq_pairs(spark: SparkSession, manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """``sample, ordinal, read_id, seq1, qual1, seq2, qual2`` of all samples in the manifest (``sample, r1, r2``).

    Mates are those with the same number in their files; both files must have the same reads in the same order. A pair of plain files
    is read by ranges of the first file; of the second file a task reads the blocks that hold the mates. Numbers of records are compared at
    once, names when the mates are read.
    """
    pairs = materialize(manifest.select("sample", _absolute("r1").alias("r1"), _absolute("r2").alias("r2")))
    split_up = pairs.filter(_plain_path("r1") & _plain_path("r2"))
    blocks = index_records(split_up.select(F.explode(F.array("r1", "r2")).alias("path")), split)
    blocks = materialize(blocks)
    counted = blocks.groupBy("path").agg(F.sum("records").alias("n"))
    one, two = (counted.select(F.col("path").alias(p), F.col("n").alias(n)) for p, n in (("r1", "n1"), ("r2", "n2")))
    both = split_up.join(one, "r1", "left").join(two, "r2", "left").select("sample", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n1", "n2")])
    expect(both, F.col("n1") == F.col("n2"), "Mate files have different numbers of records")

    first = _ranges(blocks.join(split_up.select("sample", F.col("r1").alias("path"), "r2"), "path"), "sample", "r2")
    second = blocks.join(split_up.select("sample", F.col("r2").alias("path")), "path").select("sample", "before", F.struct("byte", "before").alias("mate"))
    asked = first.select("sample", F.col("path").alias("r1"), "r2", "byte", "before", "records", F.lit(None).cast("struct<byte:bigint,before:bigint>").alias("mate"))
    # The last block of the second file that begins at the first mate of a range or before it.
    upto = Window.partitionBy("sample").orderBy("before").rangeBetween(Window.unboundedPreceding, 0)
    joined = asked.unionByName(second, allowMissingColumns=True).withColumn("mate", F.last("mate", ignorenulls=True).over(upto)).filter("r1 IS NOT NULL")
    units = joined.select("sample", "r1", "byte", "r2", F.col("mate.byte").alias("byte2"), (F.col("before") - F.col("mate.before")).alias("skip"), "before", "records")
    rest = pairs.filter(~(_plain_path("r1") & _plain_path("r2")))
    zero = F.lit(0).cast("long")
    units = units.unionByName(rest.select("sample", "r1", zero.alias("byte"), "r2", zero.alias("byte2"), zero.alias("skip"), zero.alias("before"), F.lit(None).cast("long").alias("records")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, r1, byte, r2, byte2, skip, before, count in zip(*(c.to_pylist() for c in batch.columns)):
                for left, right in together(records(r1, byte, 0, count), records(r2, byte2, skip, count), sample):
                    names, others = plain_ids(left["header"]), plain_ids(right["header"])
                    bad = pc.index(pc.equal(names, others), False).as_py()
                    if bad >= 0:
                        raise ValueError(f"The mates {left['header'][bad]} and {right['header'][bad]} of {sample} differ in name")
                    n = left.num_rows
                    number = pa.array(np.arange(before + 1, before + 1 + n))
                    before += n
                    same = pa.array([sample], pa.string()).take(pa.array(np.zeros(n, np.int64)))
                    columns = [same, number, names, left["seq"], left["qual"], right["seq"], right["qual"]]
                    yield from pa.table(columns, names=["sample", "ordinal", "read_id", "seq1", "qual1", "seq2", "qual2"]).combine_chunks().to_batches()

    return _spread(units).mapInArrow(read, f"sample STRING, {_PAIRS}")


def count_fastq_records(spark: SparkSession, paths: Sequence[str], check: bool = True) -> DataFrame:
    """Records per file from line counts; lines must come in fours."""
    counted = spark.read.text(list(paths)).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    if check:
        expect_rows(counted, "No FASTQ lines")
        expect(counted, lines_rule(), "The number of lines is no multiple of four")
    return counted.select("file", F.floor(F.col("lines") / 4).alias("records"))
