"""Near-duplicate vectors by int8 tile products with error bounds.

Every distinct vector has a home cell, that of its nearest pivot. It also visits each cell of a smaller number
whose bounding plane is near enough for a partner on the other side. So a pair meets in one cell: the smaller of
the two homes. Cells are dealt into tiles, and each pair of tiles is one unit of work.

A unit rounds its vectors to int8 with one scale each and multiplies whole tiles. The norm of each vector's rounding
error bounds how far a product is off: pairs surely below the threshold are gone, pairs surely above it are links,
and only the few between are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.vectors import keyed, matrix
from seqlattice.operators.graph import _labels, connected_components
from seqlattice.session import materialize

THRESHOLD = 0.95
TILE = 4096
# Pivots are the vectors with the smallest keys, one for each TILE vectors, and so many at most.
MAX_PIVOTS = 512
# Rows of a tile that are multiplied at once.
ROWS = 512
# Covers rounding in single precision of products that are at most about one.
SLACK = 2e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and upper bounds of the rounding error's norm of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error * (1 + 1e-9) + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` (double matrices) whose cosine is at least ``threshold``; with ``same`` each pair once.

    With rounded vectors a' and b' and error norms e and f, a product is off by at most e + f + 3 e f.
    """
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    qa, sa, ea = quantise(a / norm_a[:, None])
    qb, sb, eb = quantise(b / norm_b[:, None])
    # Sums of int8 products are exact in single precision up to 2**24.
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = np.ascontiguousarray(qb.T.astype(kind))
    wide = eb * (1 + 3 * ea.max(initial=0))
    for low in range(0, len(a), ROWS):
        rows = slice(low, low + ROWS)
        product = qa[rows].astype(kind) @ right
        product *= sa[rows, None].astype(kind)
        product *= sb[None, :].astype(kind)
        near = product >= (threshold - SLACK - ea[rows])[:, None].astype(kind) - wide[None, :].astype(kind)
        i, j = np.nonzero(near)
        value = product[i, j].astype(np.float64)
        i = i + low
        if same:
            value, i, j = value[i < j], i[i < j], j[i < j]
        link = value >= threshold + SLACK + ea[i] + wide[j]
        unsure = np.flatnonzero(~link)
        for cut in range(0, len(unsure), 1 << 16):
            u = unsure[cut : cut + (1 << 16)]
            link[u] = np.einsum("ij,ij->i", a[i[u]], b[j[u]]) / (norm_a[i[u]] * norm_b[j[u]]) >= threshold
        yield i[link], j[link]


def _contract(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of ``i`` and ``j``."""
    a, b = label[i], label[j]
    pair = np.unique(np.stack([a, b])[:, a != b], axis=1)
    return _labels(pair[0], pair[1], len(label))[label] if pair.size else label


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``df``.

    Rows link where the cosine of their vectors, in double precision, is at least ``threshold``. ``n_links`` counts
    the other rows linked directly; the component is the smallest ``vec_id`` that links reach, and ``kept`` says
    that it is the row's own. Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths with each other. Equal vectors are one vector with a count, whatever
    their number. A repeated row is one row more; a row with a null id links like any other, gives no component its
    number and is not kept. Other columns are not read.
    """
    spark = df.sparkSession
    rows = keyed(df, id_col, vec_col)
    counted = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    counted = materialize(counted.withColumn("dim", F.size("vec")))
    total = counted.groupBy("dim").count().orderBy(F.desc("count"), "dim")
    found = [_dimension(spark, counted.filter(F.col("dim") == d), n, threshold, tile) for d, n in (tuple(r) for r in total.collect())]
    if not found:
        lone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return lone.withColumn("kept", F.col("vec_id").isNotNull())
    links = found[0]
    for other in found[1:]:
        links = links.unionByName(other)
    links = materialize(links)
    component = connected_components(links.filter("key != root").select(F.col("key").alias("src"), F.col("root").alias("dst")))
    per_key = counted.select("key", "low", "weight").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    per_key = materialize(per_key.join(component.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    lowest = per_key.groupBy("component").agg(F.min("low").alias("component_id"))
    info = per_key.join(lowest, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = rows.select("vec_id", "key").join(info, "key", "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _dimension(spark, counted: DataFrame, total: int, threshold: float, tile: int) -> DataFrame:
    """``key, links, root`` of vectors of one length: links by tile unit, and a vector of the same component there."""
    pivots = counted.orderBy("key").limit(min(MAX_PIVOTS, -(-total // tile))).select("vec").toArrow()
    pivot = matrix(pivots.column(0).combine_chunks())
    pivot /= np.sqrt((pivot * pivot).sum(axis=1, keepdims=True))
    apart = np.sqrt(((pivot[:, None, :] - pivot[None, :, :]) ** 2).sum(axis=2))
    # Two unit vectors that link are at most so far apart.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    sent = spark.sparkContext.broadcast((pivot, apart))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, apart = sent.value
        for batch in batches:
            x = matrix(batch.column(2))
            if not len(x):
                continue
            near = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ pivot.T
            cell = near.argmax(axis=1)
            best = near[np.arange(len(x)), cell]
            visits = (best[:, None] - near <= reach * apart[cell]) & (np.arange(len(pivot))[None, :] < cell[:, None])
            first = np.concatenate([[0], np.cumsum(visits.sum(axis=1))])
            guests = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.nonzero(visits)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), guests], ["key", "weight", "vec", "home", "guests"])

    kind = counted.schema["vec"].dataType.simpleString()
    placed = materialize(counted.select("key", "weight", "vec").mapInArrow(home, f"key long, weight long, vec {kind}, home int, guests array<int>"))
    spots = placed.select("key", "weight", "vec", F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(False).alias("guest"))), F.transform("guests", lambda g: F.struct(g.alias("cell"), F.lit(True).alias("guest"))))).alias("at"))
    spots = spots.select("key", "weight", "vec", "at.cell", "at.guest")
    sizes = spots.groupBy("cell", "guest").count().collect()
    tiles: dict[int, list[int]] = {}
    for cell, guest, n in sizes:
        tiles.setdefault(cell, [0, 0])[guest] = -(-n // tile)
    table = spark.createDataFrame([(c, h, g) for c, (h, g) in tiles.items() if h], "cell int, homes int, visitors int")
    # One row per pivot, MAX_PIVOTS at most.
    dealt = spots.join(F.broadcast(table), "cell")
    number = F.pmod(F.xxhash64("key"), F.when(F.col("guest"), F.col("visitors")).otherwise(F.col("homes"))).cast("int")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    dealt = dealt.withColumn("tile", number)
    own = F.transform(numbers(F.col("homes")), lambda o: pair(F.least("tile", o), F.greatest("tile", o)))
    out = F.transform(numbers(F.col("visitors")), lambda o: pair(F.col("tile"), F.col("homes") + o))
    seen = F.transform(numbers(F.col("homes")), lambda o: pair(o, F.col("homes") + F.col("tile")))
    units = dealt.select("cell", "guest", "tile", "key", "weight", "vec", F.explode(F.when(F.col("guest"), seen).otherwise(F.concat(own, out))).alias("unit"))
    units = units.select("cell", F.col("unit.a").alias("a"), F.col("unit.b").alias("b"), F.when(F.col("guest"), F.lit(True)).otherwise(F.col("tile") == F.col("unit.b")).alias("right"), "key", "weight", "vec")

    def product(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.Table.from_batches(list(batches)).combine_chunks()
        a, b = columns.column("a")[0].as_py(), columns.column("b")[0].as_py()
        right = columns.column("right").to_numpy()
        key, weight = columns.column("key").to_numpy(), columns.column("weight").to_numpy()
        vec = matrix(columns.column("vec").combine_chunks())
        side = [np.flatnonzero(~right), np.flatnonzero(right)]
        if a == b:
            side[0] = side[1]
        count, label = np.zeros(len(key), np.int64), np.arange(len(key))
        for i, j in tile_links(vec[side[0]], vec[side[1]], threshold, a == b) if len(side[0]) and len(side[1]) else ():
            i, j = side[0][i], side[1][j]
            count += np.bincount(i, weight[j], len(key)).astype(np.int64) + np.bincount(j, weight[i], len(key)).astype(np.int64)
            label = _contract(label, i, j)
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(count[hit]), pa.array(key[label[hit]])], ["key", "links", "root"])

    return units.groupBy("cell", "a", "b").applyInArrow(product, "key long, links long, root long")
