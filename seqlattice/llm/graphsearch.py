"""Nearest neighbours by inner product on robust-pruned directed graphs, one for each shard.

Vectors are dealt to bands by length and in a band to shards by hash, so that a few long vectors do not decide how the others
are told apart, nor get lost among them. Appending ``sqrt(longest**2 - length**2)`` makes all of a band's vectors equally long, so the largest inner product with a query is the smallest distance. All are then moved by ``longest`` along that component,
which keeps distances and puts vectors much shorter than the longest near zero, where their differences are exact. A shard's graph starts from random edges; in
batches, each vector searches the graph greedily, and of the vectors met on the way it keeps a diverse few: the nearest is
taken, and those that are nearer to it than to the vector by the factor ``ALPHA`` leave. Queries run a beam search on
every shard; what it finds is scored again on the original vectors in double precision. A few shards and a block of queries
meet in one group of rows, which keeps the best of them for each query; neither side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.vectors import keyed, matrix
from seqlattice.session import materialize

SHARD = 4096
# Edges that pruning leaves, and edges that a point may gather from others before it is pruned again.
DEGREE = 28
ROOM = 44
ALPHA = 1.2
# Entries of the list that a search keeps when building, and entries followed at once.
BUILD = 64
WIDTH = 4
# Vectors inserted, and queries searched, together.
BATCH = 256
# Groups of shards and queries that large inputs are dealt to at least, and queries of a group, at least where there are more groups.
# Shards and queries of a group have this many components a row together, at most.
UNITS = 96
QUERIES = 1024
SHARD_ROOM = 512
QUERY_ROOM = 1 << 20
# Lengths of a band differ by this factor at most, from the longest of all down.
BAND = 16


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` nearest points met from ``start`` on for each query, nearest first, and their squared distances.

    Each round follows the edges of the WIDTH nearest entries not followed yet, until all of the list are followed. Absent
    entries are -1 at infinite distance. The squared length of the query is added at the end only: beside it the distances to
    short points may differ by less than rounding.
    """
    q, n = len(queries), len(points)
    norm = (points * points).sum(axis=1)
    size = min(size, n)
    ids = np.full((q, size), -1)
    dist = np.full((q, size), np.inf)
    done = np.zeros((q, size), bool)
    met = np.zeros((q, n + 1), bool)
    ids[:, 0] = start
    dist[:, 0] = norm[start] - 2 * (queries @ points[start])
    met[:, [start, n]] = True
    live = np.arange(q)
    while len(live):
        rows = live[:, None]
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        width = min(WIDTH, size)
        pick = np.argpartition(open_, width - 1, axis=1)[:, :width] if width < size else np.broadcast_to(np.arange(size), open_.shape)
        valid = np.isfinite(np.take_along_axis(open_, pick, 1))
        done[rows, pick] |= valid
        nearby = edges[np.where(valid, ids[rows, pick], n)].reshape(len(live), -1)
        fresh = ~met[rows, nearby]
        met[rows, nearby] = True
        nearby = np.where(fresh, nearby, n)
        # The same point twice in one row counts once.
        order = np.sort(nearby, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = n
        at, col = np.nonzero(order < n)
        far = np.full(order.shape, np.inf)
        new = order[at, col]
        far[at, col] = norm[new] - 2 * np.einsum("ij,ij->i", queries[live[at]], points[new])
        all_dist = np.concatenate([dist[live], far], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :size]
        dist[live] = np.take_along_axis(all_dist, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(np.isfinite(far), order, -1)], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(far.shape, bool)], axis=1), best, 1)
        live = live[((ids[live] >= 0) & ~done[live]).any(axis=1)]
    return ids, dist + (queries * queries).sum(axis=1)[:, None]


def robust_prune(points: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse candidates of each row; -1 stands for none.

    ``candidates`` is a matrix of point numbers, -1 for none; the row itself and repeats are left out.
    """
    count = len(points)
    cand = np.sort(np.where(candidates < 0, count, candidates), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = count
    cand[cand == rows[:, None]] = count
    padded = np.concatenate([points, np.zeros((1, points.shape[1]), points.dtype)])
    far = ((padded[cand] - points[rows][:, None, :]) ** 2).sum(axis=2)
    far[cand == count] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
    v = padded[cand]
    sq = (v * v).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive = np.isfinite(far)
    out = np.full((len(rows), degree), -1)
    every = np.arange(len(rows))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        best = alive.argmax(axis=1)
        out[some, k] = cand[every, best][some]
        alive &= alpha * alpha * between[every, best] > far
        alive[every, best] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, size: int = BUILD) -> tuple[np.ndarray, int]:
    """Edges (one row more than points, for "none"; the number of points stands for no edge) and the start point."""
    n = len(points)
    rng = np.random.default_rng(n)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n + 1, ROOM), n)
    if n > 1:
        few = min(degree // 2, n - 1)
        edges[:n, :few] = (np.arange(n)[:, None] + rng.integers(1, n, (n, few))) % n
    order = rng.permutation(n)
    for cut in range(0, n, BATCH):
        rows = order[cut : cut + BATCH]
        met, _ = beam_search(points, edges, start, points[rows], size)
        kept = robust_prune(points, rows, np.concatenate([met, np.where(edges[rows] == n, -1, edges[rows])], axis=1), degree, alpha)
        edges[rows] = n
        edges[rows, :degree] = np.where(kept < 0, n, kept)
        # The way back: added where there is room, pruned where not.
        source, slot = np.nonzero(kept >= 0)
        target, source = kept[source, slot], rows[source]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        head = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
        size_of = np.diff(np.append(head, len(target)))
        wide = np.full((len(head), int(size_of.max(initial=0))), -1)
        wide[np.repeat(np.arange(len(head)), size_of), np.arange(len(target)) - np.repeat(head, size_of)] = source
        goal = target[head]
        # Absent edges are the largest number, so sorting puts them last.
        both = np.sort(np.concatenate([edges[goal], np.where(wide < 0, n, wide)], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = n
        both = np.sort(both, axis=1)
        fits = (both[:, ROOM:] == n).all(axis=1)
        edges[goal[fits]] = both[fits, :ROOM]
        full, both = goal[~fits], both[~fits]
        for low in range(0, len(full), BATCH):
            part = robust_prune(points, full[low : low + BATCH], np.where(both[low : low + BATCH] == n, -1, both[low : low + BATCH]), degree, alpha)
            edges[full[low : low + BATCH]] = n
            edges[full[low : low + BATCH], :degree] = np.where(part < 0, n, part)
    return edges, start


def build_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, shard: int = SHARD) -> DataFrame:
    """One row per shard (numbered through the bands of a vector length): its distinct vectors, for each the ``k + 1`` smallest ids, and the graph. Written as a table.

    Every row that takes part is indexed; of more than ``k + 1`` rows with one vector only those with the smallest ids can
    be among anyone's nearest ``k``.
    """
    rows = keyed(df, id_col, vec_col).filter("key IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "vec", "key", F.size("vec").alias("dim"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    square = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    distinct = first.groupBy("key").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = materialize(distinct.withColumn("square", square))
    tops = distinct.groupBy("dim").agg(F.max("square").alias("top"))
    band = F.coalesce(F.floor((F.log("top") - F.log("square")) / (2 * np.log(BAND))), F.lit(1 << 31)).cast("long")
    distinct = distinct.join(F.broadcast(tops), "dim").withColumn("band", band)
    # One row per vector length and band.
    bands = distinct.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("of"), F.greatest(F.max("square"), F.lit(1e-300)).alias("longest"))
    bands = bands.withColumn("low", F.sum("of").over(Window.partitionBy("dim").orderBy("band")) - F.col("of"))
    dealt = distinct.join(F.broadcast(bands), ["dim", "band"]).withColumn("shard", (F.col("low") + F.pmod(F.xxhash64("key", F.lit(1)), F.col("of"))).cast("int"))

    def build(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("key").combine_chunks()
        vec = matrix(table.column("vec").combine_chunks())
        ids = table.column("ids").combine_chunks()
        edges, start = build_graph(_lifted(vec, table.column("longest")[0].as_py()))
        single = pa.types.is_float32(table.schema.field("vec").type.value_type)
        blobs = [vec.astype(np.float32 if single else np.float64).tobytes(), np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes(), ids.flatten().to_numpy().astype(np.int64).tobytes(), edges.astype(np.int32).tobytes()]
        columns = [*(table.column(c).slice(0, 1).combine_chunks() for c in ("shard", "dim", "of")), pa.array([start], pa.int32()), table.column("longest").slice(0, 1).combine_chunks(), *(pa.array([b], pa.binary()) for b in blobs)]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "dim", "of", "start", "longest", "vecs", "copies", "ids", "edges"])

    schema = "shard int, dim int, of int, start int, longest double, vecs binary, copies binary, ids binary, edges binary"
    return materialize(dealt.select("shard", "dim", "of", "longest", "key", "vec", "ids").groupBy("shard", "dim").applyInArrow(build, schema))


def _lifted(vec: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled by the longest, with one component more: what brings them to length one, less one."""
    unit = vec / np.sqrt(longest)
    square = np.minimum((unit * unit).sum(axis=1), 1)
    # 1 - sqrt(1 - square) without cancellation, and with the sign that moves the pole to zero.
    return np.concatenate([unit, -(square / (1 + np.sqrt(1 - square)))[:, None]], axis=1)


def beam_size(k: int, shards: int) -> int:
    """Entries of a query's list on each of the ``shards`` of a band.

    Vectors are dealt by hash, so a shard holds a binomial share of the nearest ``k``; the list has four entries for
    each of them up to three deviations above the mean, and 32 more.
    """
    share = k / max(shards, 1)
    return 32 + 4 * min(k, int(np.ceil(share + 3 * np.sqrt(share))))


def dealt(shards: int, queries: int, dim: int) -> tuple[int, int]:
    """How many shards make a part, and how many blocks the queries make, for vectors of ``dim`` components.

    A part and a block meet in one task. Each shard moves once for each block and each query once for each part, so both are as
    large as memory allows and as UNITS groups leave them.
    """
    most = max(QUERIES, QUERY_ROOM // dim)
    blocks = min(-(-queries // QUERIES), max(-(-queries // most), -(-UNITS // shards)))
    return max(1, min(SHARD_ROOM // dim, shards * blocks // UNITS)), blocks


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest that were found for each query, nearest first.

    Nearness is the inner product in double precision, ties go to the smaller id, and a query's own id is no candidate.
    Fewer are returned only where there are fewer. Queries whose id or vector is null, or whose vector is empty, zero or not
    finite, have no result; candidates have a vector of the query's length. Repeated query rows count once; an id
    with several different vectors is searched for each, and its best ``k`` of all of them stay.
    """
    asked = keyed(queries, id_col, vec_col).filter("key IS NOT NULL AND vec_id IS NOT NULL").dropDuplicates(["vec_id", "key"]).select(F.col("vec_id").alias("query_id"), "key", "vec", F.size("vec").alias("dim"))
    asked = materialize(asked)
    shards = {d: n + 1 for d, n in index.groupBy("dim").agg(F.max("shard")).collect()}
    deal = {d: dealt(shards[d], n, d) for d, n in asked.groupBy("dim").count().collect() if d in shards}
    per = {d: p for d, (p, _) in deal.items()}
    blocks = {d: b for d, (_, b) in deal.items()}
    parts = {d: -(-shards[d] // p) for d, p in per.items()}
    count = lambda of: F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in of.items()], F.lit(0))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    part = F.floor(F.col("shard") / F.greatest(count(per), F.lit(1))).cast("int")
    block = F.pmod(F.xxhash64("query_id", "key"), F.greatest(count(blocks), F.lit(1))).cast("int")
    left = index.select("*", part.alias("part"), F.explode(upto(count(blocks))).alias("block"))
    right = asked.select("query_id", "vec", "dim", block.alias("block"), F.explode(upto(count(parts))).alias("part"))
    # More partitions than groups, so that few of these long groups fall to one task.
    key = ["dim", "part", "block"]
    tasks = 2 * max(1, sum(parts[d] * blocks[d] for d in deal))
    left, right = (side.repartition(tasks, *key).groupBy(*key) for side in (left, right))
    found = left.cogroup(right).applyInArrow(lambda some, ask: _search_part(some, ask, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_part(shards: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """For each query the ``k`` nearest that are found on the shards."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if shards.num_rows and asked.num_rows:
        name = asked.column("query_id").to_numpy()
        query = matrix(asked.column("vec").combine_chunks())
        graphs = [_Shard(row, k) for row in shards.to_pylist()]
        for c in range(0, len(name), BATCH):
            met = [g.met(query[c : c + BATCH]) for g in graphs]
            row, who, score = (np.concatenate(x) for x in zip(*met))
            row += c
            other = who != name[row]
            for column, values in zip(out, _nearest(row[other], who[other], score[other], k)):
                column.append(values)
        out[0] = [name[r] for r in out[0]]
    return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), out)})


def _nearest(row: np.ndarray, who: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, where an id that comes with several scores counts once, with its best."""
    order = np.lexsort((-score, who, row))
    row, who, score = row[order], who[order], score[order]
    first = np.append(True, (row[1:] != row[:-1]) | (who[1:] != who[:-1]))[: len(row)]
    row, who, score = row[first], who[first], score[first]
    order = np.lexsort((who, -score, row))
    row, who, score = row[order], who[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], who[top], score[top]


class _Shard:
    """One row of the index."""

    def __init__(self, row: dict, k: int) -> None:
        self.copies = np.frombuffer(row["copies"], np.int32)
        n = len(self.copies)
        single = len(row["vecs"]) == 4 * n * row["dim"]
        self.vec = np.frombuffer(row["vecs"], np.float32 if single else np.float64).reshape(n, -1).astype(np.float64)
        self.member = np.frombuffer(row["ids"], np.int64)
        self.at = np.cumsum(self.copies) - self.copies
        self.edge = np.frombuffer(row["edges"], np.int32).reshape(n + 1, -1).astype(np.int64)
        self.points = _lifted(self.vec, row["longest"])
        self.start = row["start"]
        self.beam = beam_size(k, row["of"])

    def met(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, id and inner product of all that the queries find here."""
        n = len(self.vec)
        if n <= self.beam:
            # The list holds the whole shard.
            near = np.broadcast_to(np.arange(n), (len(query), n))
        else:
            length = np.sqrt((query * query).sum(axis=1, keepdims=True))
            lifted = np.concatenate([query / length, np.full((len(query), 1), -1.0)], axis=1)
            near = beam_search(self.points, self.edge, self.start, lifted, self.beam)[0]
        row, col = np.nonzero(near >= 0)
        point = near[row, col]
        score = np.einsum("ij,ij->i", self.vec[point], query[row])
        times = self.copies[point]
        end = np.cumsum(times)
        who = self.member[np.arange(times.sum()) + np.repeat(self.at[point] - (end - times), times)]
        return np.repeat(row, times), who, np.repeat(score, times)
