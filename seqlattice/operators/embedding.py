"""Variable features, scaling and principal components; the neighbour graph is in ``neighbors``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seqlattice.contracts import require
from seqlattice.operators.counts import CellDataset
from seqlattice.operators.markers import log_normalize
from seqlattice.operators.neighbors import knn_cosine
from seqlattice.session import materialize

TREND_BINS = 1000
SPAN = 0.3
CLIP = 10.0


# --- variable features ---------------------------------------------------------------------------


def gene_moments(counts: DataFrame, features: DataFrame, cells: int) -> DataFrame:
    """Mean and sample variance of raw counts per gene over all cells, zeros in closed form."""
    x = F.col("count").cast("double")
    sums = counts.groupBy("gene").agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"), F.count(F.lit(1)).alias("nonzero"))
    rows = features.select("gene").join(sums, "gene", "left").na.fill(0)
    variance = F.greatest(F.lit(0.0), (F.col("_q") - F.col("_s") * F.col("_s") / cells) / max(cells - 1, 1))
    return rows.select("gene", "nonzero", (F.col("_s") / cells).alias("mean"), variance.alias("variance"))


def local_trend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, span: float = SPAN) -> np.ndarray:
    """Local quadratic regression with tricube weights over the nearest ``span`` share of points."""
    order = np.argsort(x, kind="stable")
    xs, ys, ws = x[order], y[order], weight[order]
    need = max(span * ws.sum(), min(3.0, ws.sum()))
    fitted = np.empty_like(ys)
    for i, center in enumerate(xs):
        distance = np.abs(xs - center)
        near = np.argsort(distance, kind="stable")
        reach = distance[near[min(np.searchsorted(np.cumsum(ws[near]), need), len(near) - 1)]]
        inside = distance <= reach
        kernel = ws * inside
        if reach > 0:
            kernel = ws * np.clip(1 - (distance / (reach * 1.000001)) ** 3, 0, None) ** 3
        used = kernel > 0
        degree = min(2, int(used.sum()) - 1)
        design = np.vander(xs[used] - center, degree + 1, increasing=True)
        root = np.sqrt(kernel[used])
        fitted[i] = np.linalg.lstsq(design * root[:, None], ys[used] * root, rcond=None)[0][0]
    out = np.empty_like(fitted)
    out[order] = fitted
    return out


def trend_table(moments: DataFrame, bins: int = TREND_BINS, span: float = SPAN) -> tuple[DataFrame, float, float]:
    """Fitted log10 variance per bin of log10 mean; at most ``bins`` rows pass the driver."""
    points = moments.filter("variance > 0").select(F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    edge = points.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    require(edge["low"] is not None, "No gene varies")
    low, width = edge["low"], max((edge["high"] - edge["low"]) / bins, 1e-12)
    index = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    binned = points.groupBy(index.alias("bin")).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("w")
    )
    rows = binned.orderBy("bin").toPandas()
    fit = local_trend(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["w"].to_numpy(float), span)
    following = np.append(np.arange(1, len(rows)), len(rows) - 1)
    run = rows["x"].to_numpy()[following] - rows["x"].to_numpy()
    rise = fit[following] - fit
    slope = np.divide(rise, run, out=np.zeros_like(rise), where=run > 0)
    table = pd.DataFrame({"bin": rows["bin"], "at": rows["x"], "fit": fit, "slope": slope})
    return moments.sparkSession.createDataFrame(table, "bin INT, at DOUBLE, fit DOUBLE, slope DOUBLE"), low, width


def variable_features(data: CellDataset, n: int, cells: int | None = None, bins: int = TREND_BINS) -> DataFrame:
    """The ``n`` genes with the largest standardised variance, ranked.

    Expected variance comes from the trend of log10 variance on log10 mean; values are standardised
    with it and clipped at the square root of the number of cells. The trend is fitted to the mean points of ``bins``
    equal steps of log10 mean, weighted by their genes, and runs straight from one to the next.
    """
    require(n >= 2, "At least two variable features are needed")
    cells = data.cells.count() if cells is None else cells
    moments = materialize(gene_moments(data.counts, data.features, cells))
    trend, low, width = trend_table(moments, bins)
    index = F.least(F.floor((F.log10("mean") - low) / width), F.lit(bins - 1)).cast("int")
    expected = F.col("fit") + F.col("slope") * (F.log10("mean") - F.col("at"))
    sds = (
        moments.filter("variance > 0")
        .withColumn("bin", index)
        .join(F.broadcast(trend), "bin")
        .select("gene", "mean", "nonzero", F.sqrt(F.pow(F.lit(10.0), expected)).alias("sd"))
    )
    clip = float(np.sqrt(cells))
    z = F.least(F.lit(clip), (F.col("count") - F.col("mean")) / F.col("sd"))
    squares = data.counts.join(sds, "gene").groupBy("gene").agg(F.sum(z * z).alias("_z2"))
    zero = F.pow(F.col("mean") / F.col("sd"), 2) * (F.lit(cells) - F.col("nonzero"))
    scored = sds.join(squares, "gene", "left").select(
        "gene",
        F.round((F.coalesce("_z2", F.lit(0.0)) + zero) / max(cells - 1, 1), 10).alias("variance_standardized"),
    )
    constant = moments.filter("variance <= 0").select("gene", F.lit(0.0).alias("variance_standardized"))
    # n is the number of features asked for; only they are ranked in one place.
    top = scored.unionByName(constant).orderBy(F.desc("variance_standardized"), "gene").limit(n)
    order = Window.orderBy(F.desc("variance_standardized"), F.col("gene"))
    return top.withColumn("rank", F.row_number().over(order))


# --- scaling and components ----------------------------------------------------------------------


def scale_genes(normalized: DataFrame, genes: DataFrame, cells: int, clip: float = CLIP) -> DataFrame:
    """Z-scores of the non-zero values, with each gene's score for a zero alongside."""
    rows = normalized.join(genes.select("gene"), "gene")
    sums = rows.groupBy("gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mean = F.coalesce("_s", F.lit(0.0)) / cells
    variance = (F.coalesce("_q", F.lit(0.0)) - F.coalesce("_s", F.lit(0.0)) * mean) / max(cells - 1, 1)
    stats = materialize(
        genes.join(sums, "gene", "left")
        .withColumn("_mean", mean)
        .withColumn("_sd", F.sqrt(F.greatest(F.lit(0.0), variance)))
        .withColumn("_sd", F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0))
        .drop("_s", "_q")
    )
    return rows.join(stats, "gene").select(
        *[c for c in genes.columns],
        "cell",
        F.least(F.lit(clip), (F.col("value") - F.col("_mean")) / F.col("_sd")).alias("z"),
        (-F.col("_mean") / F.col("_sd")).alias("z0"),
    )


def principal_components(scaled: DataFrame, cells: DataFrame, genes: int, k: int) -> DataFrame:
    """``cell, pcs`` from z-scores with a gene ``rank`` from 1; the scores of each component have mean zero.

    Components do not change when a column is shifted, so each cell's sparse vector holds differences from the zero score, and
    only of the genes it expresses. The fitted transform multiplies these differences as they are; the product of their
    means with the loadings, one vector of ``k`` numbers, is taken off afterwards.
    """
    entry = F.struct((F.col("rank") - 1).cast("int").alias("i"), (F.col("z") - F.col("z0")).alias("d"))
    entries = scaled.groupBy("cell").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    none = F.array().cast("array<struct<i:int,d:double>>")
    vectors = cells.select("cell").join(entries, "cell", "left").select("cell", F.coalesce("_e", none).alias("_e"))
    # The stored form of a sparse vector: kind 0, size, indices, values.
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(genes).alias("size"), F.col("_e.i").alias("indices"), F.col("_e.d").alias("values")
    )
    rows = vectors.select("cell", stored.alias("features"))
    kinds = [StructField("features", VectorUDT()) if f.name == "features" else f for f in rows.schema.fields]
    table = materialize(rows, StructType(kinds))
    model = PCA(k=k, inputCol="features", outputCol="_pcs").fit(table)
    scores = model.transform(table).select("cell", vector_to_array("_pcs").alias("pcs"))
    centre = scores.agg(*[F.avg(F.col("pcs")[i]).alias(f"m{i}") for i in range(k)]).first()
    shift = F.array(*[F.lit(float(centre[i] or 0.0)) for i in range(k)])
    return scores.select("cell", F.zip_with("pcs", shift, lambda s, m: s - m).alias("pcs"))


def component_count(cells: int, genes: int, wanted: int = 30) -> int:
    require(cells >= 4 and genes >= 3, "Too small to embed: fewer than 4 cells or 3 genes")
    k = min(wanted, cells - 1, genes - 1)
    require(k >= 2, "Too few dimensions for an embedding")
    return k


def embed(data: CellDataset, n_features: int = 3000, components: int = 30, dims: int = 30, neighbors: int = 30):
    """Normalise, pick features, scale, reduce and link cells; returns ``(pcs, graph)``."""
    cells = data.cells.count()
    genes = data.features.select("gene").distinct().count()
    component_count(cells, genes, components)
    top = materialize(variable_features(data, min(n_features, genes), cells))
    chosen = top.count()
    k = component_count(cells, chosen, components)
    normalized = log_normalize(data.counts)
    scaled = scale_genes(normalized, top.select("gene", "rank"), cells)
    pcs = materialize(principal_components(scaled, data.cells, chosen, k))
    space = pcs.select("cell", F.slice("pcs", 1, min(dims, k)).alias("vector"))
    return pcs, knn_cosine(space, min(neighbors, cells - 1), key="cell")


def embed_group(data: CellDataset, group: str, **options):
    """Embed one group on its own, again from the raw counts."""
    return embed(data.select_cells(F.col("group") == group), **options)


def coordinates(data: CellDataset, pcs: DataFrame) -> DataFrame:
    """Cells with their labels and component coordinates ``PC_1 ..``."""
    width = pcs.select(F.size("pcs").alias("n")).first()["n"]
    spread = pcs.select("cell", *[F.col("pcs")[i].alias(f"PC_{i + 1}") for i in range(width)])
    return data.cells.join(spread, "cell")
