"""Nearest neighbours by cosine on packed blocks."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.contracts import require
from seqlattice.session import materialize

LOG = logging.getLogger(__name__)
# Vectors that are drawn as the first centres, and rounds in which centres move to their members' mean.
MAX_CENTERS = 1024
ROUNDS = 3
# Blocks whose summaries are compared in one task.
CHUNK = 512
DIGITS = 10
# Angle by which two cosines can differ that are equal after rounding.
SLOP = 2e-5
# Bytes of vectors in a tile, the unit that moves in the exact search, and the least number of tiles, for parallel work.
TILE_BYTES = 32 << 20
MIN_TILES = 8
# Rows of the two sides of one product inside a pair of tiles, and candidates that are gathered before only the best are kept.
QUERY_ROWS, DATA_ROWS = 256, 4096
PENDING = 1 << 20


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _centers(base: DataFrame, count: int) -> np.ndarray:
    """``count`` directions: hashed vectors, moved to the mean of the vectors nearest to them a few times.

    Only ``count`` vectors travel through the driver in each round.
    """
    center = _unit(_rows(base.orderBy(F.xxhash64("id"), "id").limit(count).select("u").toArrow().column(0).combine_chunks()))
    width = center.shape[1]
    for _ in range(ROUNDS if count > 1 else 0):
        here = center

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(here), width))
            for batch in batches:
                u = _rows(batch.column(0))
                if len(u):
                    np.add.at(total, (u @ here.T).argmax(axis=1), u)
            hit = np.flatnonzero(total.any(axis=1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * width, pa.int32()), pa.array(total[hit].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(hit), flat], ["c", "s"])

        part = base.select("u").mapInArrow(sums, "c long, s array<double>")
        added = F.array(*[F.sum(F.col("s")[i]) for i in range(width)])
        moved = part.groupBy("c").agg(added.alias("s")).toArrow()
        center = center.copy()
        center[moved.column("c").to_numpy()] = _unit(_rows(moved.column("s").combine_chunks()))
    return center


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` by similarity, then id; similarities are rounded, so equal vectors tie."""
    keep = np.arange(len(sims))
    if len(sims) > k:
        keep = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
    return keep[np.lexsort((ids[keep], -sims[keep]))][:k]


class _Best:
    """The best ``k`` candidates of each row of a tile, by similarity, then id; ``bound`` is what a new one has to reach."""

    def __init__(self, bound: np.ndarray, rank: np.ndarray, k: int):
        self.bound, self.rank, self.k = bound, rank, k
        self.row, self.place, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        value = np.round(value, DIGITS)
        fine = value >= self.bound[row]
        self.waiting.append((row[fine], place[fine], value[fine]))
        self.count += int(fine.sum())
        if self.count > PENDING:
            self.trim()

    def trim(self) -> None:
        if not self.count:
            return
        parts = [(self.row, self.place, self.value), *self.waiting]
        row, place, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((self.rank[place], -value, row))
        row, place, value = row[order], place[order], value[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        full = nth == self.k - 1
        # As good as the worst kept so far may still win by its id.
        self.bound[row[full]] = np.maximum(self.bound[row[full]], value[full])
        keep = (nth < self.k) & (value >= self.bound[row])
        self.row, self.place, self.value = row[keep], place[keep], value[keep]
        self.waiting, self.count = [], 0


def knn_cosine(
    vectors: DataFrame, k: int, key: str = "cell", vector: str = "vector", block_rows: int = 4096, mode: str = "exact", nearest_blocks: int = 8
) -> DataFrame:
    """``k`` nearest neighbours by cosine: ``key, neighbor, similarity, rank``; a row is never its own neighbour.

    Vectors are dealt to their nearest centre and cut into blocks of about ``block_rows``, each stored as one packed row with its
    mean direction and the largest angle to it. Every block is searched in itself first; the worst angle that its rows
    still have to beat bounds its search. Block summaries, without vectors, are compared: a pair of blocks is planned if
    by the triangle inequality something closer may lie in the other. The number of planned pairs is logged.

    ``mode="exact"`` visits all planned pairs, which without any clusters is every pair of blocks: quadratic work. What moves are tiles of
    TILE_BYTES, neighbouring blocks together: a vector is sent once for each tile that its own meets, not for each block. A pair
    of tiles is computed once for both directions and hands on at most ``k`` rows for each vector.
    ``mode="nearest_blocks"`` keeps the ``nearest_blocks`` planned blocks nearest to each block: linear and approximate. A pair of blocks is
    one unit of work there.
    """
    require(k >= 1, "k must be at least 1")
    require(mode in ("exact", "nearest_blocks"), "mode must be 'exact' or 'nearest_blocks'")
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    unit = F.transform(vector, lambda v: F.coalesce(F.try_divide(v.cast("double"), F.col("_norm")), v.cast("double")))
    base = materialize(vectors.withColumn("_norm", norm).select(F.col(key).alias("id"), unit.alias("u")))
    kind = base.schema["id"].dataType.simpleString()
    total = base.count()
    if total == 0:
        return spark.createDataFrame([], f"{key} {kind}, neighbor {kind}, similarity DOUBLE, rank INT")
    center = _centers(base, min(MAX_CENTERS, -(-total // block_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _rows(batch.column(1))
            near = (u @ center.T).argmax(axis=1) if len(u) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["id", "u", "center"])

    placed = materialize(base.mapInArrow(place, f"id {kind}, u array<double>, center int"))
    # One row per centre, MAX_CENTERS at most.
    parts = {r["center"]: r["parts"] for r in placed.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")).collect()}
    along = [c for c in _chain(center) if c in parts]
    before = np.cumsum([0, *[parts[c] for c in along]])
    tiles = max(-(-total * center.shape[1] * 8 // TILE_BYTES), MIN_TILES)
    columns = [pa.array(along, pa.int32()), pa.array([parts[c] for c in along], pa.int32()), pa.array(before[:-1])]
    known = spark.createDataFrame(pa.table(columns, names=["center", "parts", "before"]))
    dealt = placed.join(F.broadcast(known), "center").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("tile", F.floor((F.col("before") + F.col("part")) * tiles / int(before[-1])).cast("int"))

    def pack(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, u = table.column("id").to_numpy(zero_copy_only=False), _rows(table.column("u").combine_chunks())
        middle = _unit(u.mean(axis=0, keepdims=True))[0]
        radius = float(np.arccos(np.clip(u @ middle, -1, 1)).max())
        bound, found = [], []
        for at in range(0, len(ids), 512):
            sims = np.round(u[at : at + 512] @ u.T, DIGITS)
            for r, row in enumerate(sims):
                other = np.arange(len(ids)) != at + r
                best = np.flatnonzero(other)[_best(ids[other], row[other], k)]
                found.append((best.tolist(), row[best].tolist()))
                bound.append(float(row[best[-1]]) if len(best) == k else -1.0 - SLOP)
        near = pa.array([[(int(i), s) for i, s in zip(*f)] for f in found], pa.list_(pa.struct([("i", pa.int32()), ("s", pa.float64())])))
        name = f"{table.column('center')[0].as_py()}:{table.column('part')[0].as_py()}"
        reach = float(np.arccos(np.clip(min(bound), -1, 1)))
        columns = [
            pa.array([name]), table.column("tile")[:1].combine_chunks(), pa.array([radius]), pa.array([reach]), pa.array([middle.tolist()]),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), table.column("id").combine_chunks()),
            pa.array([u.tobytes()], pa.binary()), pa.array([np.array(bound).tobytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), near),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["block", "tile", "radius", "reach", "middle", "ids", "rows", "bounds", "near"])

    layout = f"block string, tile int, radius double, reach double, middle array<double>, ids array<{kind}>, rows binary, bounds binary, near array<array<struct<i:int,s:double>>>"
    blocks = materialize(dealt.select("center", "part", "tile", "id", "u").groupBy("center", "part").applyInArrow(pack, layout))
    own = blocks.select("ids", F.explode(F.arrays_zip("ids", "near")).alias("z")).select("ids", F.col("z.ids").alias("id"), F.explode("z.near").alias("n"))
    inner = own.select("id", F.col("ids")[F.col("n.i")].alias("neighbor"), F.col("n.s").alias("similarity"))
    found = inner.unionByName(_all_across(blocks, k, kind) if mode == "exact" else _nearest_across(blocks, k, kind, nearest_blocks))
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(key), "neighbor", "similarity", "rank")


def _chain(center: np.ndarray) -> list[int]:
    """The centres in an order in which each is followed by the nearest one left, so that tiles hold near blocks."""
    sims = center @ center.T
    order, left = [0], np.ones(len(center), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, sims[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return order


def _wanted(gap: np.ndarray, radius: tuple[np.ndarray, np.ndarray], reach: np.ndarray) -> np.ndarray:
    """Which blocks, as columns, may hold something for a row of the blocks that are rows."""
    return gap - radius[0][:, None] - radius[1][None, :] <= reach[:, None] + SLOP


def _plan(table: pa.Table, side: np.ndarray) -> np.ndarray:
    """Pairs of the blocks of two tiles, or of a tile with itself, that are to be visited, in either direction."""
    middle = _rows(table.column("middle").combine_chunks())
    radius, reach = table.column("radius").to_numpy(), table.column("reach").to_numpy()
    gap = np.arccos(np.clip(middle[side] @ middle[~side].T, -1, 1))
    there = _wanted(gap, (radius[side], radius[~side]), reach[side])
    return there | _wanted(gap.T, (radius[~side], radius[side]), reach[~side]).T


def _meetings(some: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blocks of both tiles of each pair ``a, b``; a tile that meets itself comes as both sides."""
    left = some.join(F.broadcast(pairs), F.col("tile") == F.col("a")).withColumn("left", F.lit(True))
    return left.unionByName(some.join(F.broadcast(pairs), F.col("tile") == F.col("b")).withColumn("left", F.lit(False)))


def _all_across(blocks: DataFrame, k: int, kind: str) -> DataFrame:
    """Neighbours in other blocks, by pairs of tiles that hold a planned pair of blocks."""
    summary = blocks.select("tile", "block", "radius", "reach", "middle")
    names = summary.select("tile").distinct()
    every = names.select(F.col("tile").alias("a")).crossJoin(names.select(F.col("tile").alias("b"))).filter("a <= b")

    def planned(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        plan = _plan(table, table.column("left").to_numpy(zero_copy_only=False))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        visits = int(plan.sum()) - (len(plan) if a == b else 0)
        if visits:
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([visits])], ["a", "b", "visits"])

    pairs = materialize(_meetings(summary, every).groupBy("a", "b").applyInArrow(planned, "a int, b int, visits long"))
    LOG.info("cosine neighbours: %d pairs of %d blocks planned", pairs.agg(F.sum("visits")).first()[0] or 0, blocks.count())

    def product(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("left").to_numpy(zero_copy_only=False)
        same = table.column("a")[0] == table.column("b")[0]
        if same:
            # A tile that meets itself has each block twice: in the same order on both sides.
            order = np.lexsort((table.column("block").to_numpy(zero_copy_only=False), ~side))
            table, side = table.take(pa.array(order)), side[order]
        plan = _plan(table, side)
        half = []
        for mine in (side, ~side):
            part = table.filter(pa.array(mine))
            ids = pa.chunked_array([c.flatten() for c in part.column("ids").chunks]).combine_chunks()
            size = np.array([len(r) for r in part.column("ids")])
            rows = np.concatenate([np.frombuffer(r.as_buffer()) for r in part.column("rows")]).reshape(len(ids), -1)
            bound = np.concatenate([np.frombuffer(r.as_buffer()) for r in part.column("bounds")])
            rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            half.append((ids, rows, bound, rank, np.repeat(np.arange(len(size)), size)))
        del table
        (q_ids, q, q_bound, q_rank, q_block), (d_ids, d, d_bound, d_rank, d_block) = half
        there, back = _Best(q_bound, d_rank, k), _Best(d_bound, q_rank, k)
        for at in range(0, len(q), QUERY_ROWS):
            near = slice(at, at + QUERY_ROWS)
            visited = np.flatnonzero(plan[np.unique(q_block[near])].any(axis=0)[d_block])
            for start in range(0, len(visited), DATA_ROWS):
                which = visited[start : start + DATA_ROWS]
                sims = q[near] @ d[which].T
                # A little less than the bound, as sums are rounded afterwards.
                for best, low in ((there, there.bound[near, None]), (back, back.bound[which])):
                    if same and best is back:
                        continue
                    i, j = np.nonzero(sims >= low - 10.0**-DIGITS)
                    if same:
                        other = q_block[at + i] != d_block[which[j]]
                        i, j = i[other], j[other]
                    if len(i):
                        pair = (at + i, which[j]) if best is there else (which[j], at + i)
                        best.add(*pair, sims[i, j])
        for best, mine, theirs in ((there, q_ids, d_ids), (back, d_ids, q_ids)):
            best.trim()
            if len(best.row):
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(best.row)), theirs.take(pa.array(best.place)), pa.array(best.value)], ["id", "neighbor", "similarity"])

    sent = blocks.select("tile", "block", "radius", "reach", "middle", "ids", "rows", "bounds")
    return _meetings(sent, pairs.select("a", "b")).groupBy("a", "b").applyInArrow(product, f"id {kind}, neighbor {kind}, similarity double")


def _pairs(blocks: DataFrame) -> DataFrame:
    """``a, b, gap``: blocks ``b`` that may hold something for a row of ``a``; ``gap`` is the angle between their means."""
    summary = blocks.select("block", "radius", "reach", "middle")
    chunks = -(-summary.count() // CHUNK)
    dealt = summary.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    other = F.sequence(F.lit(0), F.lit(chunks - 1))
    left = dealt.select("*", F.lit(True).alias("left"), F.explode(other).alias("o")).withColumn("unit", F.struct(F.col("chunk").alias("a"), F.col("o").alias("b")))
    right = dealt.select("*", F.lit(False).alias("left"), F.explode(other).alias("o")).withColumn("unit", F.struct(F.col("o").alias("a"), F.col("chunk").alias("b")))

    def near(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        side = table.column("left").to_numpy(zero_copy_only=False)
        name, middle = table.column("block").to_numpy(zero_copy_only=False), _rows(table.column("middle").combine_chunks())
        radius, reach = table.column("radius").to_numpy(), table.column("reach").to_numpy()
        gap = np.arccos(np.clip(middle[side] @ middle[~side].T, -1, 1))
        wanted = _wanted(gap, (radius[side], radius[~side]), reach[side])
        wanted &= name[side][:, None] != name[~side][None, :]
        i, j = np.nonzero(wanted)
        yield pa.RecordBatch.from_arrays([pa.array(name[side][i], pa.string()), pa.array(name[~side][j], pa.string()), pa.array(gap[i, j])], ["a", "b", "gap"])

    both = left.unionByName(right).select("unit.a", "unit.b", "left", "block", "radius", "reach", "middle")
    return both.groupBy("a", "b").applyInArrow(near, "a string, b string, gap double")


def _nearest_across(blocks: DataFrame, k: int, kind: str, nearest_blocks: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy("gap", "b")
    pairs = materialize(_pairs(blocks).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= nearest_blocks).drop("n"))
    LOG.info("cosine neighbours: %d pairs of %d blocks planned", pairs.count(), blocks.count())
    query = blocks.select(F.col("block").alias("a"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("bounds").alias("q_bounds"))
    data = blocks.select(F.col("block").alias("b"), F.col("ids").alias("d_ids"), F.col("rows").alias("d_rows"))
    units = pairs.select("a", "b").join(query, "a").join(data, "b").select("q_ids", "q_rows", "q_bounds", "d_ids", "d_rows")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q_rows, q_bounds, d_ids, d_rows = (c[r] for c in batch.columns)
                q_name, d_name = q_ids.values, d_ids.values
                order = d_name.to_numpy(zero_copy_only=False)
                q = np.frombuffer(q_rows.as_py()).reshape(len(q_name), -1)
                d = np.frombuffer(d_rows.as_py()).reshape(len(d_name), -1)
                bound = np.frombuffer(q_bounds.as_py())
                who, which, value = [], [], []
                for at in range(0, len(q), 512):
                    sims = np.round(q[at : at + 512] @ d.T, DIGITS)
                    # As good as the worst kept so far may still win by its id.
                    for row in np.flatnonzero((sims >= bound[at : at + 512, None]).any(axis=1)):
                        better = np.flatnonzero(sims[row] >= bound[at + row])
                        best = better[_best(order[better], sims[row][better], k)]
                        who.append(np.full(len(best), at + row))
                        which.append(best)
                        value.append(sims[row][best])
                if who:
                    yield pa.RecordBatch.from_arrays(
                        [q_name.take(pa.array(np.concatenate(who))), d_name.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(value))],
                        ["id", "neighbor", "similarity"],
                    )

    return units.mapInArrow(product, f"id {kind}, neighbor {kind}, similarity double")
