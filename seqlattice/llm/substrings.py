"""Removal of repeated word runs by windows of fixed length, dealt to groups by a prefix in them.

A suffix is the word sequence from one place on; two suffixes that agree in their first ``size`` words would meet in a
node of depth ``size`` of a suffix tree, and a window is repeated exactly if its node there had two leaves or more. No tree is
built: of each subtree only that one level is found, by comparing windows, and no maximal repeats come out. Suffixes are dealt to
groups by a prefix and each group is compared in memory:

* Neighbouring suffixes travel together. Each window names the ``PREFIX`` consecutive words in it whose hash is
  smallest (the leftmost of equal ones); equal windows name the same words. The suffix at that place and the windows
  that named it, about fourteen, are one entry of the group of that prefix, so a suffix is not sent once for each window.
* All windows are counted by a hash of their prefix first. Light prefixes share a group; the windows of a prefix
  that is too frequent for one group are dealt by a longer one, the whole window.
* Windows that occur twice within one piece of the input are settled there, and only one of them is sent on. A
  passage that a third of all texts share is one entry for each piece.

An edge of a subtree carries the 48-bit hash of its words and is compared below one 64-bit prefix hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from seqlattice.llm import words
from seqlattice.llm.names import col, columns, free, map_arrow
from seqlattice.llm.words import U64
from seqlattice.session import materialize

WINDOW = 35
PREFIX = 8
# Counters of windows by prefix hash, and windows that a group's subtree may hold.
SLOTS = 1 << 14
GROUP = 1 << 20
# Bytes of text that one map step settles together.
PIECE = 2 << 20

# Words that are searched for smallest prefixes at a time, and the bits of a place in them.
STRETCH = 1 << 24
_PLACE = U64(STRETCH - 1)


def _windows(data: np.ndarray, offsets: np.ndarray, size: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Text, place within the text, prefix place, prefix hash and hash of each window."""
    found = words.split(data, offsets)
    n = len(found.hash)
    count = np.diff(found.first)
    wide = np.maximum(count - size + 1, 0)
    text = np.repeat(np.arange(found.texts), wide)
    local = words._within(wide)
    at = found.first[:-1][text] + local
    if not len(at):
        none = np.zeros(0, U64)
        return text, local, at, none, none
    sums = np.zeros(n + 1, U64)
    np.cumsum(words.mix(found.hash) * words._UP.upto(n), out=sums[1:])
    down = words._DOWN.upto(n + 1)
    heads = np.arange(n - prefix + 1)
    head = words.mix((sums[heads + prefix] - sums[heads]) * down[heads])
    anchor = np.empty(len(at), np.int64)
    span = size - prefix + 1
    for begin in range(0, len(heads), STRETCH - span):
        # Ordered by hash, then by place in the stretch: the smallest of ``span`` neighbours is found by doubling.
        part = head[begin : begin + STRETCH]
        low, reach = (words.mix(part) & ~_PLACE) | np.arange(len(part), dtype=U64), 1
        while reach * 2 <= span <= len(part):
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        a, b = np.searchsorted(at, [begin, begin + STRETCH - span])
        here = at[a:b] - begin
        if len(here):
            anchor[a:b] = (np.minimum(low[here], low[here + span - reach]) & _PLACE).astype(np.int64) + begin
    whole = words.mix((sums[at + size] - sums[at]) * down[at] + U64(size))
    return text, local, anchor, head[anchor], whole


def _slot(head: np.ndarray) -> np.ndarray:
    return (words.mix(head + U64(1)) % U64(SLOTS)).astype(np.int64)


def _plan(counts: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each slot: neighbours share a group up to its size, a heavy slot has several."""
    parts = np.maximum(-(-counts // group), 1)
    base, current, held = np.zeros(SLOTS, np.int64), 0, 0
    for s, (c, p) in enumerate(zip(counts.tolist(), parts.tolist())):
        if held and (p > 1 or held + c > group):
            current, held = current + 1, 0
        base[s] = current
        held += c
        if p > 1:
            current, held = current + p, 0
    return base, parts


def _runs(text: np.ndarray, local: np.ndarray, anchor: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Where runs of consecutive windows of one text and prefix place begin; ``single`` windows stay alone."""
    opens = np.ones(len(text), bool)
    if len(text) > 1:
        opens[1:] = (np.diff(text) != 0) | (np.diff(local) != 1) | (np.diff(anchor) != 0) | single[1:] | single[:-1]
    return np.flatnonzero(opens)


_ENTRY = "grp long, keys binary, starts binary, sizes binary, heads binary, low binary, high binary, settled binary"
_SPAN = "row_key long, start long, size long"


def _spans(keys: np.ndarray, starts: np.ndarray, hit: np.ndarray, run: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Stretches of hit windows; ``run`` is the entry of a window and ``place`` its number there."""
    at = np.flatnonzero(hit)
    opens = np.ones(len(at), bool)
    if len(at) > 1:
        opens[1:] = (np.diff(at) != 1) | (np.diff(run[at]) != 0)
    head = np.flatnonzero(opens)
    size = np.diff(np.append(head, len(at)))
    first = at[head]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[run[first]]), pa.array(starts[run[first]] + place[first]), pa.array(size.astype(np.int64))], ["row_key", "start", "size"]
    )


def repeated_spans(docs: DataFrame, size: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``row_key, start, size``: ``size`` windows from word ``start`` on whose words also start elsewhere in the table.

    ``docs`` has ``row_key`` (long) and ``text``. The spans of a row may touch.
    """
    spark = docs.sparkSession
    rows = docs.select("row_key", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, data, offsets in words.few_pieces(batch.column(1), PIECE):
                total += np.bincount(_slot(_windows(data, offsets, size, prefix)[3]), minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    counted = rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in counted.collect():
        counts[slot] = n
    plan = spark.sparkContext.broadcast(_plan(counts, group))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, parts = plan.value
        for batch in batches:
            for row, data, offsets in words.few_pieces(batch.column(1), PIECE):
                key = batch.column(0).slice(row, len(offsets) - 1).to_numpy()
                text, local, anchor, head, whole = _windows(data, offsets, size, prefix)
                if not len(text):
                    continue
                order = np.argsort(whole, kind="stable")
                same = np.zeros(len(order), bool)
                same[1:] = whole[order[1:]] == whole[order[:-1]]
                later = np.zeros(len(order), bool)
                later[order] = same
                twice = np.zeros(len(order), bool)
                twice[order] = same | np.append(same[1:], False)
                begin = _runs(text, local, anchor, np.zeros(len(text), bool))
                run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(text))))
                found = _spans(key[text[begin]], local[begin], twice, run, np.arange(len(text)) - begin[run])
                # Settled here; these rows only pass through the shuffle below.
                for cut in range(0, found.num_rows, 4096):
                    part = found.slice(cut, 4096)
                    yield _entry(-1 - int(key[0]) % 64, [c.to_numpy() for c in part.columns[:2]] + [part.column(2).to_numpy().astype(np.uint32)] + [np.zeros(0, np.uint8)] * 4)
                text, local, anchor, head, whole, twice = (a[~later] for a in (text, local, anchor, head, whole, twice))
                slot = _slot(head)
                heavy = parts[slot] > 1
                begin = _runs(text, local, anchor, heavy)
                sizes = np.diff(np.append(begin, len(text)))
                to = base[slot[begin]] + np.where(heavy[begin], (whole[begin] >> U64(8)) % parts[slot[begin]].astype(U64), 0).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                for entry in np.split(order, cuts):
                    windows = np.repeat(begin[entry], sizes[entry]) + words._within(sizes[entry])
                    edge = whole[windows]
                    yield _entry(
                        int(to[entry[0]]),
                        [key[text[begin[entry]]], local[begin[entry]], sizes[entry].astype(np.uint32), head[begin[entry]], (edge >> U64(16)).astype(np.uint32), (edge & U64(0xFFFF)).astype(np.uint16), np.packbits(twice[windows])],
                    )

    def subtree(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for batch in batches:
            for k, kind in enumerate((np.int64, np.int64, np.uint32, U64, np.uint32, np.uint16, np.uint8)):
                columns[k] += [np.frombuffer(b, kind) for b in batch.column(k + 1).to_pylist()]
        settled = [np.unpackbits(b)[: len(low)].astype(bool) for b, low in zip(columns[6], columns[4])]
        keys, starts, sizes, heads, low, high = map(np.concatenate, columns[:6])
        if not len(heads):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(starts), pa.array(sizes.astype(np.int64))], ["row_key", "start", "size"])
            return
        run = np.repeat(np.arange(len(sizes)), sizes)
        yield _spans(keys, starts, deep_leaves(heads[run], low, high) & ~np.concatenate(settled), run, words._within(sizes.astype(np.int64)))

    entries = rows.mapInArrow(deal, _ENTRY)
    return entries.groupBy("grp").applyInArrow(subtree, _SPAN)


def deep_leaves(head: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which windows of a group are there more than once; equal ones lie together once sorted by prefix and hash."""
    node = words.mix(head * U64(0x9E3779B97F4A7C15) + ((low.astype(U64) << U64(16)) | high.astype(U64)))
    order = np.argsort(node)
    same = node[order[1:]] == node[order[:-1]]
    out = np.zeros(len(node), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _entry(grp: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([grp], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
    return pa.RecordBatch.from_arrays(columns, ["grp", "keys", "starts", "sizes", "heads", "low", "high", "settled"])


def dedup(docs: DataFrame, size: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, text_col: str = "text", kept_col: str = "kept", counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` with ``kept`` and ``counts``, the numbers of its words and of those removed.

    Words are ``[^\\x20\\x09-\\x0D]+``. Each word covered by ``size`` consecutive words of one text whose sequence also
    starts anywhere else in the table, the same text included, is removed; windows are judged on the input. ``kept``
    are the other words joined by one space. A null text has no words and keeps the empty text. A repeated
    row repeats its own windows. Columns of ``docs`` with the new names are replaced, all others kept.

    A row is known by the 64-bit hash of its columns that can be hashed; rows with equal values share their spans, which
    are equal too.
    """
    new = (kept_col, *counts)
    hashed = [col(f.name) for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row = F.xxhash64(*hashed)
    spans = repeated_spans(docs.select(row.alias("row_key"), col(text_col).cast("string").alias("text")), size, prefix, group)
    spans = materialize(spans)
    key, text, of, found = free(docs, "row_key", "row_text", "span_key", "spans")
    lists = spans.groupBy("row_key").agg(F.collect_list(F.struct("start", "size")).alias("spans")).toDF(of, found)
    joined = docs.select("*", row.alias(key)).join(lists, F.col(key) == F.col(of), "left")
    out = joined.select(*columns(docs, new), col(text_col).cast("string").alias(text), F.col(found)["start"].alias(key), F.col(found)["size"].alias(of))
    schema = StructType(docs.select(*columns(docs, new)).schema.fields).add(kept_col, StringType()).add(counts[0], LongType()).add(counts[1], LongType())

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, start, length = batch.columns[-3:]
            kept, total, gone = [], [], []
            for k in range(batch.num_rows):
                found = (text[k].as_py() or "").encode().split()
                total.append(len(found))
                if start[k].is_valid:
                    edge = np.zeros(len(found) + 1, np.int64)
                    at = np.array(start[k].as_py())
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array(length[k].as_py()) + size - 1, -1)
                    found = list(compress(found, (np.cumsum(edge[:-1]) == 0).tolist()))
                gone.append(total[-1] - len(found))
                kept.append(b" ".join(found).decode())
            columns = [*batch.columns[:-3], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(out, strip, schema)
