"""Set similarity join of word n-grams by prefix trees.

1. A set can only link if at least the threshold's share of its n-grams occur in another set. All n-grams are counted
   by ranges of their hash, and sets below that share leave: their component is settled.
2. The n-grams of the sets left are ordered from rare to frequent, ties by hash. Two sets that link share one of
   their first ``n - least overlap + 1`` n-grams in this order, so the sets below one such n-gram are tied to its smallest
   set, and the connected sets form a cell. No link leaves a cell.
3. The sets of a cell are put into a tree of their ordered n-grams. A set descends from the root with the overlap so
   far; it shares the work for all sets below a node and turns back where the n-grams left, on the shorter side, cannot
   bring the overlap that the sizes ask for, or where everything below is in its component already.

A cell too large for one task is dealt into tiles, and each pair of tiles is a tree of its own. A tree hands on its components, as
one row for each set with the smallest set of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from seqlattice.llm import bloom, names, words
from seqlattice.llm.words import U64
from seqlattice.operators.graph import connected_components
from seqlattice.session import materialize

SHINGLE = 5
# Link where intersection * 100 >= THRESHOLD * union.
THRESHOLD = 80
# N-grams of a hash range, of a tree, and sets of a tree.
RANGE = 1_000_000
# Counters of the suspects' n-grams by hash, kept in slices; see _ordered.
COUNTERS = 1 << 18
SLICES = 64
# The bit of an n-gram that says its set has counted it.
_MARK = U64(1 << 32)
TREE_GRAMS = 2_000_000
TREE_SETS = 2_048
# Bits that hold whether a set has an odd number of n-grams of each hash value.
SIGN_BITS = 2_048


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; A-Z are lower-cased."""
    grams, first = words.shingles(words.split(data, offsets, lower=True), size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        run = np.sort(grams[a:b])
        yield run[np.append(True, run[1:] != run[:-1])] if len(run) else run


def _name(grams: np.ndarray) -> int:
    """64-bit name of a set, whatever the order of its n-grams."""
    total = np.add.reduce(words.mix(grams + U64(1)), keepdims=True) + np.full(1, len(grams), U64) * U64(0x9E3779B97F4A7C15)
    return int(words.mix(total).view(np.int64)[0])


def set_names(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key, text_key`` per row; an empty set has no key. ``text_key`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in words.few_pieces(batch.column(1)):
                found = [(len(s), _name(s) if len(s) else None) for s in _sets(data, offsets, size)]
                counts, keys = zip(*found)
                columns = [batch.column(0).slice(row, len(found)), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), batch.column(2).slice(row, len(found))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "text_key"])

    rows = docs.select(names.col(id_col).cast("long").alias("doc_id"), names.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key long, text_key long")


_BLOCK = "part long, keys binary, counts binary, grams binary"


def _block(part: int, keys: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (keys, counts, grams))]
    return pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts", "grams"])


def _deal(names: np.ndarray, sets: list[np.ndarray], parts: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The n-grams of many sets by hash range; ``kind`` is what is kept of a hash."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Bit 32 is a mark and has no say in where an n-gram goes.
    part = ((flat & ~_MARK) % U64(parts)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        rows = order[bounds[p] : bounds[p + 1]]
        if len(rows):
            own = owner[rows]
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            kept = flat[rows] if kind is U64 else (flat[rows] >> U64(32)).astype(kind)
            yield _block(p, names[own[head]], np.diff(np.append(head, len(rows))).astype(np.uint32), kept)


def _gathered(batches: Iterator[pa.RecordBatch], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and n-grams of a range, each set once."""
    columns: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for k, dtype in enumerate((np.int64, np.uint32, kind)):
            columns[k] += [np.frombuffer(b, dtype) for b in batch.column(k + 1).to_pylist()]
    keys, counts, grams = map(np.concatenate, columns)
    counts = counts.astype(np.int64)
    distinct, where = np.unique(keys, return_index=True)
    if len(distinct) < len(keys):
        place, _ = words.ragged(np.concatenate([[0], np.cumsum(counts)]), where)
        keys, counts, grams = distinct, counts[where], grams[place]
    return keys, counts, grams


def _often(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a range, and how many of their n-grams there occur in another set and are not counted yet.

    A set may come from several pieces of the input, with other n-grams left out in each; an n-gram of one set is one, and it is
    counted already if any of its copies is marked.
    """
    columns: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for k, dtype in enumerate((np.int64, np.uint32, np.uint32)):
            columns[k] += [np.frombuffer(b, dtype) for b in batch.column(k + 1).to_pylist()]
    keys, counts, grams = map(np.concatenate, columns)
    distinct, owner = np.unique(keys, return_inverse=True)
    # N-gram, set and mark in one number, so one sort brings equal ones together; the mark is the lowest bit of ``grams``.
    value = (grams >> np.uint32(1)).astype(U64) << U64(33)
    value |= np.repeat(owner.astype(U64), counts) << U64(1)
    value |= (grams & np.uint32(1)).astype(U64)
    value.sort()
    pair = value >> U64(1)
    last = np.append(pair[1:] != pair[:-1], True)
    pair, marked = pair[last], (value[last] & U64(1)).astype(bool)
    gram = pair >> U64(32)
    head = np.append(True, gram[1:] != gram[:-1])
    sets = np.diff(np.append(np.flatnonzero(head), len(gram)))
    counted = (np.repeat(sets, sets) > 1) & ~marked
    often = np.bincount((pair[counted] & U64(0xFFFFFFFF)).astype(np.int64), minlength=len(distinct))
    return distinct[often > 0], often[often > 0].astype(np.uint32)


def _frequency(grams: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    order = np.argsort(grams)
    sorted_grams = grams[order]
    head = np.flatnonzero(np.append(True, sorted_grams[1:] != sorted_grams[:-1]))
    out = np.empty(len(grams), np.int64)
    size = np.diff(np.append(head, len(grams)))
    out[order] = np.repeat(size, size)
    return out


def _settled(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """What each set has to send, and how many of its n-grams another of these sets has as well.

    An n-gram of several sets stays in the first of them only, marked in bit 32, so one that very many sets share is sent
    once for each piece of the input. N-grams travel without their low bits; those of one set that agree in the others would be taken for
    one, and each counts here as shared, so no set counts fewer than it has.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    later = np.zeros(len(flat), bool)
    later[order[1:][same]] = True
    shared = later.copy()
    shared[order[:-1][same]] = True
    sent = np.where(shared, flat | _MARK, flat & ~_MARK)[~later]
    kept = np.bincount(owner[~later], minlength=len(sets))
    alike = ((flat[1:] ^ flat[:-1]) >> U64(33) == 0) & (owner[1:] == owner[:-1])
    again = np.bincount(owner[1:][alike], minlength=len(sets))
    return np.split(sent, np.cumsum(kept)[:-1]), np.bincount(owner[shared], minlength=len(sets)) + again


def _suspects(docs: DataFrame, sets: DataFrame, size: int, threshold: int, parts: int) -> DataFrame:
    """Sets of ``sets`` (set_key, n_shingles, doc_id) of whose n-grams the threshold's share occurs in another set."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in words.few_pieces(batch.column(0)):
                found = {_name(s): s for s in _sets(data, offsets, size) if len(s)}
                if found:
                    names, sets, twice = np.array(list(found), np.int64), *_settled(list(found.values()))
                    hit = np.flatnonzero(twice)
                    for cut in range(0, len(hit), 4096):
                        rows = hit[cut : cut + 4096]
                        yield _block(-1 - int(names[rows[0]] % 64), names[rows], twice[rows].astype(np.uint32), np.zeros(0, np.uint32))
                    yield from _deal(names, sets, parts, np.uint32)

    def shared(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _key[0].as_py() < 0:
            # Counts of n-grams that were settled before, one row at a time.
            settled = [(np.frombuffer(k, np.int64), np.frombuffer(c, np.uint32)) for b in batches for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keys, often = (np.concatenate(c) for c in zip(*settled))
        else:
            keys, often = _often(batches)
        # The counts of many sets travel in one row, by a hash of their key.
        part = (words.mix(keys.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
            columns = [pa.array([part[rows[0]]], pa.int64()), pa.array([keys[rows].tobytes()], pa.binary()), pa.array([often[rows].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "keys", "often"])
        words.release()

    def total(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = [], []
        for batch in batches:
            keys += [np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()]
            often += [np.frombuffer(b, np.uint32) for b in batch.column(2).to_pylist()]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, np.concatenate(often)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(sums)], ["set_key", "often"])

    blocks = docs.mapInArrow(deal, _BLOCK).groupBy("part").applyInArrow(shared, "part long, keys binary, often binary")
    often = blocks.groupBy("part").applyInArrow(total, "set_key long, often long")
    return sets.join(often, "set_key").filter(F.col("often") * 100 >= F.col("n_shingles") * threshold).select("set_key", "n_shingles", "doc_id")


def _counters(sets: DataFrame) -> np.ndarray:
    """How many n-grams of ``sets`` fall to each of COUNTERS hash values; one row for each slice reaches the driver."""
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for cut in range(0, len(blobs), 1000):
                grams = np.frombuffer(b"".join(blobs[cut : cut + 1000]), U64)
                total += np.bincount((grams % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        rows = [s for s in range(SLICES) if total[s * width : (s + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([total[s * width : (s + 1) * width].tobytes() for s in rows], pa.binary())], ["slice", "counts"])

    def add(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for b in batch.column(1).to_pylist():
                total += np.frombuffer(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([_key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

    out = np.zeros(COUNTERS, np.int64)
    schema = "slice long, counts binary"
    for at, counts in sets.select("grams").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect():
        out[at * width : (at + 1) * width] = np.frombuffer(counts, np.int64)
    return out


def _ordered(sets: DataFrame, parts: int) -> DataFrame:
    """``set_key, grams`` of ``sets``: n-grams as order keys, the class of their frequency above their hash, sorted.

    The class is 0 to 127 by the logarithm of the exact frequency. N-grams whose counter is above an eighth of RANGE and eight times
    the mean may be too many for one task; their class is 128 and more by the logarithm of the counter, and they are not gathered.
    Either way the class is a function of the n-gram, so the order is one for all sets.
    """
    counts = _counters(sets)
    level = 128 + np.minimum(127, 3 * np.log2(np.maximum(counts, 1))).astype(np.int64)
    hot = np.where(counts > max(RANGE // 8, 8 * counts.mean()), level, 0).astype(np.uint8)
    sent = sets.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            names, sets = batch.column(0).to_numpy(), [np.frombuffer(b, U64) for b in batch.column(1).to_pylist()]
            known = [hot[(s % U64(COUNTERS)).astype(np.int64)] for s in sets]
            yield from _deal(names, [s[k == 0] for s, k in zip(sets, known)], parts, U64)
            for name, s, k in zip(names.tolist(), sets, known):
                if k.any():
                    # These pass through with their class in place.
                    ranked = (k[k > 0].astype(U64) << U64(56)) | (s[k > 0] >> U64(8))
                    yield _block(-1 - name % 64, np.array([name]), np.array([len(ranked)], np.uint32), ranked)

    def rank(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _key[0].as_py() < 0:
            for batch in batches:
                keys = np.concatenate([np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(3)], ["set_key", "grams"])
            return
        keys, counts, grams = _gathered(batches, U64)
        level = np.minimum(127, np.round(8 * np.log2(_frequency(grams)))).astype(U64)
        ranked = (level << U64(56)) | (grams >> U64(8))
        stop = np.cumsum(counts)
        for cut in range(0, len(keys), 2048):
            rows = range(cut, min(cut + 2048, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut : rows.stop]), pa.array([ranked[stop[r] - counts[r] : stop[r]].tobytes() for r in rows], pa.binary())], ["set_key", "grams"])
        words.release()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.unique(np.frombuffer(b"".join(parts), U64)).tobytes() for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], ["set_key", "grams"])

    ranked = sets.select("set_key", "grams").mapInArrow(deal, _BLOCK).groupBy("part").applyInArrow(rank, "set_key long, grams binary")
    return ranked.groupBy("set_key").agg(F.collect_list("grams").alias("grams")).mapInArrow(join, "set_key long, grams binary")


def _ties(ordered: DataFrame, threshold: int) -> DataFrame:
    """``src, dst``: each set and the smallest set with the same prefix n-gram."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = []
            for b in batch.column(1).to_pylist():
                n = len(b) // 8
                lead.append(np.frombuffer(b, np.int64)[: n + (-n * threshold) // 100 + 1])
            size = [len(a) for a in lead]
            doc = np.repeat(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate(lead))], ["set_key", "gram"])

    entries = ordered.mapInArrow(prefix, "set_key long, gram long")
    low = entries.groupBy("gram").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low < high").select("gram", "low")
    return entries.join(low, "gram").filter("set_key > low").select(F.col("set_key").alias("src"), F.col("low").alias("dst")).distinct()


class Tree:
    """Ordered sets in a compressed prefix tree, with the components that links have joined so far."""

    class Node:
        __slots__ = ("grams", "children", "sets", "low", "high", "same")

        def __init__(self, grams: np.ndarray):
            self.grams = grams
            self.children: dict[int, Tree.Node] = {}
            self.sets: list[int] = []
            self.low, self.high = 1 << 62, 0
            self.same: int | None = None

    def __init__(self, threshold: int):
        self.threshold = threshold
        self.root = Tree.Node(np.zeros(0, U64))
        self.parent: list[int] = []
        self.signs: list[int] = []

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def add(self, grams: np.ndarray) -> list[tuple[int, int]]:
        """Insert a set; the links found that join its component with another."""
        me = len(self.parent)
        self.parent.append(me)
        odd = np.bincount((grams % U64(SIGN_BITS)).astype(np.int64), minlength=SIGN_BITS) & 1
        self.signs.append(int.from_bytes(np.packbits(odd.astype(np.uint8)).tobytes(), "big"))
        links: list[tuple[int, int]] = []
        self._search(self.root, grams, me, 0, 0, 0, links)
        self._insert(grams, me)
        return links

    def _hopeless(self, node: Node, n: int, used: int, depth: int, overlap: int) -> bool:
        """Whether no set below can link: the size that allows most, within the sizes below, is still too little."""
        size = min(max(n - used + depth, node.low), node.high)
        most = overlap + min(n - used, size - depth)
        return most * (100 + self.threshold) < self.threshold * (n + size)

    def _unlike(self, a: int, b: int, sizes: int) -> bool:
        """Whether two sets surely differ in too many n-grams: each odd bit that differs stands for one at least."""
        return (self.signs[a] ^ self.signs[b]).bit_count() * (100 + self.threshold) > (100 - self.threshold) * sizes

    def _search(self, node: Node, grams: np.ndarray, me: int, used: int, depth: int, overlap: int, links: list) -> None:
        n, stack = len(grams), [(node, used, depth, overlap)]
        while stack:
            node, used, depth, overlap = stack.pop()
            if node.same is not None and self.find(node.same) == self.find(me):
                continue
            if node is not self.root and self._hopeless(node, n, used, depth, overlap):
                continue
            if node.sets and not node.children and self._unlike(me, node.sets[0], n + node.high):
                continue
            if len(node.grams):
                rest = grams[used:]
                at = np.searchsorted(rest, node.grams)
                inside = at < len(rest)
                overlap += int((rest[at[inside]] == node.grams[inside]).sum())
                used += int(np.searchsorted(rest, node.grams[-1], "right"))
                depth += len(node.grams)
                if self._hopeless(node, n, used, depth, overlap):
                    continue
            for other in node.sets:
                if overlap * 100 >= self.threshold * (n + depth - overlap) and self.find(other) != self.find(me):
                    self.parent[self.find(other)] = self.find(me)
                    links.append((other, me))
            if node.same is None and not node.children and node.sets:
                if len({self.find(s) for s in node.sets}) == 1:
                    node.same = node.sets[0]
            elif node.same is None and node.children:
                self._settle(node)
            stack += [(child, used, depth, overlap) for child in node.children.values()]

    def _settle(self, node: Node) -> None:
        """Note that all sets below are in one component, once they are."""
        below = [c.same for c in node.children.values()]
        if all(s is not None for s in below) and len({self.find(s) for s in [*below, *node.sets]}) == 1:
            node.same = below[0]

    def _insert(self, grams: np.ndarray, me: int) -> None:
        node, rest, n = self.root, grams, len(grams)
        while True:
            node.low, node.high, node.same = min(node.low, n), max(node.high, n), None
            if not len(rest):
                node.sets.append(me)
                return
            child = node.children.get(int(rest[0]))
            if child is None:
                child = node.children[int(rest[0])] = Tree.Node(rest)
                child.low = child.high = n
                child.sets.append(me)
                child.same = me
                return
            size = min(len(child.grams), len(rest))
            differ = np.flatnonzero(child.grams[:size] != rest[:size])
            shared = int(differ[0]) if len(differ) else size
            if shared < len(child.grams):
                upper = Tree.Node(child.grams[:shared])
                upper.low, upper.high = child.low, child.high
                upper.children[int(child.grams[shared])] = child
                node.children[int(rest[0])] = upper
                child.grams = child.grams[shared:]
                child = upper
            node, rest = child, rest[shared:]


def _tree_links(ordered: DataFrame, cells: DataFrame, threshold: int) -> DataFrame:
    """``src, dst``: each set and the smallest of its component, from the tree of each cell or pair of its tiles."""
    sized = ordered.select("set_key", "grams", (F.octet_length("grams") / 8).cast("long").alias("n"))
    member = materialize(sized.drop("grams").join(cells.select(F.col("node").alias("set_key"), "component"), "set_key"))
    cell = member.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    tiles = F.greatest(F.ceil(F.col("sets") / TREE_SETS), F.ceil(F.col("total") / TREE_GRAMS)).cast("long")
    cell = cell.select("component", tiles.alias("tiles"), "total")
    buckets = -(-(cell.filter("tiles = 1").agg(F.sum("total")).first()[0] or 0) // TREE_GRAMS) or 1
    placed = member.join(cell.select("component", "tiles"), "component").withColumn("tile", F.pmod(F.xxhash64("set_key"), F.col("tiles")))
    # One unit per pair of tiles; cells of one tile share units, with a tree each.
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("r"), F.greatest("tile", o).alias("s")))
    small = F.col("tiles") == 1
    units = placed.select(
        "set_key", "component", F.when(small, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component")).alias("unit"), small.alias("small"), F.explode(pair).alias("pair")
    ).select("set_key", "component", "unit", "small", "pair.r", "pair.s")
    filled = units.join(ordered, "set_key").select("unit", "small", "r", "s", "component", "set_key", "grams")

    def run(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for c, d, g in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6))):
                held.setdefault(c, []).append((d, g))
        out: list[tuple[int, int]] = []
        for sets in held.values():
            tree, names = Tree(threshold), []
            for doc, grams in sorted(sets):
                names.append(doc)
                tree.add(np.frombuffer(grams, U64))
            low: dict[int, int] = {}
            for k, doc in enumerate(names):
                first = low.setdefault(tree.find(k), doc)
                if doc != first:
                    out.append((doc, first))
        src, dst = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return filled.groupBy("unit", "small", "r", "s").applyInArrow(run, "src long, dst long")


def _id_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return words.mix(batch.column(0).to_numpy().view(U64) + U64(1))


def _linked(docs: DataFrame, size: int, threshold: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``set_names`` of the rows, and ``set_key, root`` of each set: equal roots are connected by links."""
    texts = docs.select(names.col(id_col).cast("long").alias("doc_id"), names.col(text_col).cast("string").alias("text"))
    named = materialize(set_names(texts, size))
    sets = named.filter("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    suspects = materialize(_suspects(texts.filter("doc_id IS NOT NULL").select("text"), sets, size, threshold, max(1, -(-total // RANGE))))
    kept, count = suspects.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()

    # Texts of other ids are left where they are; the join is exact for the rest.
    likely = docs.sparkSession.sparkContext.broadcast(bloom.build(suspects.select("doc_id"), count, _id_hashes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.contains(likely.value, _id_hashes(batch))))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in words.few_pieces(batch.column(2)):
                keys = batch.column(1).slice(row, len(offsets) - 1).to_pylist()
                found = [(k, s) for k, s in enumerate(_sets(data, offsets, size)) if _name(s) == keys[k]]
                rows = pa.array([row + k for k, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), pa.array([s.tobytes() for _, s in found], pa.binary())], ["set_key", "grams"])

    picked = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(pick, "doc_id long, text string")
    # Shuffled whatever its size: a broadcast would put both steps in Python into one task, with a worker each, and workers stay.
    chosen = suspects.select("doc_id", "set_key").hint("merge").join(picked, "doc_id").select("doc_id", "set_key", "text")
    left = materialize(chosen.mapInArrow(grams, "set_key long, grams binary"))
    ordered = materialize(_ordered(left, max(1, -(-kept // RANGE))))
    cells = connected_components(_ties(ordered, threshold))
    links = connected_components(_tree_links(ordered, materialize(cells), threshold))
    # Sets are linked by their keys, as one id may have several.
    linked = sets.join(links.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    return named, linked.select("set_key", "doc_id", F.coalesce("component", "set_key").alias("root"))


def join(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct runs of ``size`` words, or the whole
    sequence of a shorter text. Two rows link where ``100 * intersection >= threshold * union``; the component is the
    smallest ``doc_id`` that links reach. Null, empty and blank texts have the empty set and link with nothing. Rows of
    equal sets are one set, so copies are not paired up; a repeated row is one row more. A row with a null id
    links with nothing and has a null component. Other columns are not read.

    N-grams are 64-bit hashes, of which trees compare 56 bits; that two different ones of a table meet has a probability of about
    its number of n-grams squared over 2**57.
    """
    named, linked = _linked(docs, size, threshold, id_col, text_col)
    lowest = linked.groupBy("root").agg(F.min("doc_id").alias("component"))
    component = linked.join(lowest, "root").select("set_key", "component")
    joined = named.join(component, "set_key", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows: that with the smallest id, of several the one whose text has the smallest hash.

    Of rows that agree in id and text one stays. Rows with a null id link with nothing and all stay; so do rows without words, one for each
    id and text. Columns are kept as they are, whatever their names.

    Rows are judged by id and a 64-bit hash of the text. Only rows that are, or by a Bloom filter may be, copies of something are moved.
    """
    named, linked = _linked(docs, size, threshold, id_col, text_col)
    roots = named.filter("doc_id IS NOT NULL").groupBy("doc_id", "text_key", "set_key").agg(F.count(F.lit(1)).alias("rows"))
    roots = materialize(roots.join(linked.select("set_key", "root"), "set_key", "left").select("doc_id", "text_key", "root", "rows"))
    first = roots.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    judged = roots.join(first, "root", "left")
    stays = F.col("root").isNull() | (F.struct("doc_id", "text_key") == F.col("first"))
    copies = materialize(judged.select("doc_id", "text_key", stays.alias("stays"), "rows").filter("NOT stays OR rows > 1").select("doc_id", "text_key", "stays"))

    likely = docs.sparkSession.sparkContext.broadcast(bloom.build(copies, copies.count(), _row_hashes))
    rows, number, key = names.free(docs, "row_id", "row_text", "row_copy")
    keyed = docs.select(*names.columns(docs), names.col(id_col).cast("long").alias(rows), F.xxhash64(names.col(text_col).cast("string")).alias(number))

    @F.arrow_udf(BooleanType())
    def maybe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            yield pa.array(bloom.contains(likely.value, _pair_hashes(ids.to_numpy(), texts.to_numpy())))

    marked = keyed.withColumn(key, F.col(rows).isNotNull() & maybe(F.coalesce(rows, F.lit(0)), number))
    of, text, stay = names.free(marked, "copy_id", "copy_text", "copy_stays")
    # A row that is no copy has an id and text of its own, so dropping repeats changes nothing for it.
    near = marked.filter(F.col(key)).dropDuplicates([rows, number])
    near = near.join(copies.toDF(of, text, stay), (F.col(rows) == F.col(of)) & (F.col(number) == F.col(text)), "left").filter(f"coalesce({stay}, true)")
    kept = names.columns(docs)
    return marked.filter(~F.col(key)).select(*kept).unionByName(near.select(*kept))


def _pair_hashes(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(ids.view(U64) + U64(1)) + texts.view(U64))


def _row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return _pair_hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
