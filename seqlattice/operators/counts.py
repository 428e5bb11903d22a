"""Molecule counting and sparse gene-by-cell matrices in long form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.contracts import expect, expect_references, expect_unique, require
from seqlattice.operators.graph import GROUP_EDGES, grouped_components
from seqlattice.operators.ordering import row_numbers, scan, slice_rows
from seqlattice.session import materialize


# --- molecules -----------------------------------------------------------------------------------


def dedup_umis(
    tagged: DataFrame, cell: str = "CB", gene: str = "gene_id", umi: str = "UB", method: str = "unique",
    max_edges: int = GROUP_EDGES,
) -> DataFrame:
    """Molecules per cell and gene as ``gene, cell, count``.

    ``unique`` counts distinct UMIs. ``directional`` merges UMIs that differ in one base where the
    larger has at least twice the reads of the smaller minus one.
    """
    keys = tagged.select(F.col(cell).alias("cell"), F.col(gene).alias("gene"), F.col(umi).alias("umi"))
    keys = keys.filter(F.col("cell").isNotNull() & F.col("gene").isNotNull() & (F.col("umi") != ""))
    if method == "unique":
        return keys.groupBy("gene", "cell").agg(F.count_distinct("umi").alias("count"))
    require(method == "directional", "method must be 'unique' or 'directional'")
    return _directional(keys, max_edges)


def _directional(keys: DataFrame, max_edges: int) -> DataFrame:
    """Count clusters without walking a graph per group.

    A cluster starts at a UMI that no earlier UMI (in order of reads) leads to. From two reads up,
    every link comes from a strictly larger UMI, so such a UMI starts a cluster exactly if it has no
    link at all. UMIs with one read link each other both ways: a connected set of them starts one
    cluster, unless a larger UMI touches it.

    Neighbours are found by masking one position at a time. UMIs sharing a mask differ only there, so
    a mask group is no larger than the alphabet, however large the (cell, gene) group is.
    """
    node = ["cell", "gene", "umi"]
    umis = materialize(keys.groupBy(*node).agg(F.count(F.lit(1)).alias("n")))
    masked = umis.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("umi")))).withColumn(
        "_mask", F.concat(F.expr("substring(umi, 1, _at - 1)"), F.lit("\x00"), F.expr("substring(umi, _at + 1)"))
    )
    group = Window.partitionBy("cell", "gene", "_mask")
    near = masked.select(
        *node,
        "n",
        F.max("n").over(group).alias("_top"),
        F.min(F.when(F.col("n") == 1, F.col("umi"))).over(group).alias("_first"),
    )
    linked = (F.col("_top") >= 2 * F.col("n") - 1) & (F.col("_top") > F.col("n"))
    parents = near.groupBy(*node, "n").agg(F.max(linked).alias("_linked"))
    starts = parents.filter(~F.col("_linked"))

    single = F.col("n") == 1
    edges = near.filter(single & (F.col("_first") != F.col("umi"))).select(
        "cell", "gene", F.col("umi").alias("src"), F.col("_first").alias("dst")
    )
    components = grouped_components(edges.distinct(), ["cell", "gene"], max_edges)
    ones = parents.filter(single).select("cell", "gene", F.col("umi").alias("node"), "_linked")
    sets = (
        ones.join(components, ["cell", "gene", "node"], "left")
        .groupBy("cell", "gene", F.coalesce("component", "node").alias("component"))
        .agg(F.max("_linked").alias("_linked"))
        .filter(~F.col("_linked"))
        .select("cell", "gene")
    )
    clusters = starts.filter(~single).select("cell", "gene").unionByName(sets)
    return clusters.groupBy("gene", "cell").agg(F.count(F.lit(1)).alias("count"))


# --- names ---------------------------------------------------------------------------------------


def make_unique(df: DataFrame, column: str, ordinal: str, name: str) -> DataFrame:
    """Add unique names: repeats of ``x`` become ``x.1``, ``x.2``, ... skipping names already given."""
    numbered = row_numbers(df, [column], [ordinal], "_rank").withColumn("_repeat", F.col("_rank") - 1)
    repeated = numbered.filter(F.col("_repeat") == 1).select(F.col(column).alias("_base"))
    suffix = r"^(.*)\.([1-9][0-9]*)$"
    given = (
        df.select(column)
        .distinct()
        .filter(F.col(column).rlike(suffix))
        .select(
            F.regexp_extract(column, suffix, 1).alias("_base"),
            F.expr(f"try_cast(regexp_extract({column}, '{suffix.replace(chr(92), chr(92) * 2)}', 2) AS BIGINT)").alias("_j"),
        )
        .filter(F.col("_j").isNotNull())
        .join(repeated, "_base", "left_semi")
    )
    if given.isEmpty():
        label = F.when(F.col("_repeat") > 0, F.concat(F.col(column), F.lit("."), F.col("_repeat"))).otherwise(F.col(column))
        return numbered.withColumn(name, label).drop("_rank", "_repeat")
    # The k-th repeat takes the k-th free number: k plus the given numbers j_i with j_i - i < k.
    ranked = row_numbers(given, ["_base"], ["_j"], "_i").select(
        "_base", (F.col("_j") - F.col("_i")).alias("_key"), F.lit(1).cast("bigint").alias("_given"), F.lit(None).cast("bigint").alias("_k")
    )
    wanted = numbered.filter(F.col("_repeat") > 0).select(
        F.col(column).alias("_base"), F.col("_repeat").alias("_key"), F.lit(0).cast("bigint").alias("_given"), F.col("_repeat").alias("_k")
    )
    mixed = slice_rows(ranked.unionByName(wanted), ["_base"], ["_key", "_given"])
    shifted = (
        scan(mixed, ["_base"], ["_key", "_given"], "_skip", "_given")
        .filter(F.col("_given") == 0)
        .select(F.col("_base").alias(column), F.col("_k").alias("_repeat"), "_skip")
    )
    label = F.when(
        F.col("_repeat") > 0, F.concat(F.col(column), F.lit("."), F.col("_repeat") + F.col("_skip"))
    ).otherwise(F.col(column))
    return numbered.join(shifted, [column, "_repeat"], "left").withColumn(name, label).drop("_rank", "_repeat", "_skip")


def feature_names(features: DataFrame, gene: str = "gene_id", ordinal: str = "ordinal") -> DataFrame:
    """Unique gene ids, then underscores to hyphens, then unique again, as ``feature``."""
    first = make_unique(features, gene, ordinal, "_unique")
    dashed = first.withColumn("_dashed", F.translate("_unique", "_", "-"))
    return make_unique(dashed, "_dashed", ordinal, "feature").drop("_unique", "_dashed")


# Counts that one task is meant to add up.
GROUP_ROWS = 500_000


def _dealt(rows: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """Rows dealt to ``parts`` tasks by the keys they are added up by; with None the session's setting does it."""
    return rows if parts is None else rows.repartition(parts, *keys)


# --- matrices ------------------------------------------------------------------------------------


def gene_totals(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """Sum of counts per gene and cell; genes with only zeros stay."""
    return _dealt(counts, ["gene", "cell"], parts).groupBy("gene", "cell").agg(F.sum("count").cast("bigint").alias("count"))


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.sum("count").cast("bigint").alias("total"))


def wide_counts(counts: DataFrame, samples: Sequence[str], gene: str = "gene", gene_label: str = "gene_id") -> DataFrame:
    """Gene-by-sample table with zeros filled in and columns in the given order."""
    totals = counts.groupBy(gene).pivot("cell", list(samples)).agg(F.sum("count").cast("bigint"))
    return totals.na.fill(0, subset=list(samples)).withColumnRenamed(gene, gene_label)


def annotate_features(genes: DataFrame, annotation: DataFrame) -> DataFrame:
    """Gene name and type per gene id; the id itself and ``NA`` where the annotation has none."""
    return genes.join(annotation, "gene_id", "left").select(
        *genes.columns,
        F.coalesce("gene_name", "gene_id").alias("gene_name"),
        F.coalesce("gene_type", F.lit("NA")).alias("gene_type"),
    )


def collapse_features(
    counts: DataFrame, names: DataFrame, gene: str = "gene", name: str = "gene_name", parts: int | None = None
) -> DataFrame:
    """Sum the rows of genes sharing a name; genes without a name are dropped."""
    valid = names.filter(F.col(name).isNotNull() & (F.col(name) != "")).select(gene, name)
    return (
        _dealt(counts.join(valid, gene), [name, "cell"], parts)
        .groupBy(F.col(name).alias("gene"), "cell")
        .agg(F.sum("count").cast("bigint").alias("count"))
    )


@dataclass(frozen=True)
class CellDataset:
    """A sparse count matrix: non-zero ``counts(gene, cell, count)``, all ``features``, all ``cells``.

    ``parts`` is the number of tasks in which its counts are added up, so that one task's share is bounded whatever their number.
    """

    counts: DataFrame
    features: DataFrame
    cells: DataFrame
    provenance: DataFrame | None = None
    parts: int | None = None

    @classmethod
    def from_counts(
        cls, counts: DataFrame, features: DataFrame | None = None, cells: DataFrame | None = None, parts: int | None = None
    ) -> CellDataset:
        totals = gene_totals(counts, parts)
        if features is None:
            features = counts.select("gene").distinct()
        if cells is None:
            cells = counts.select("cell").distinct()
        return cls(totals.filter("count > 0"), features, cells, parts=parts)

    @classmethod
    def from_matrix(
        cls,
        entries: DataFrame,
        features: DataFrame,
        barcodes: DataFrame,
        min_cells: int = 0,
        min_features: int = 0,
        metadata: DataFrame | None = None,
        check: bool = True,
    ) -> CellDataset:
        """Build from 1-based ``(i, j, x)`` entries and ordinal feature and barcode tables."""
        if check:
            expect(features, F.col("gene_id").isNotNull() & (F.col("gene_id") != ""), "Empty gene id")
            expect(barcodes, F.col("cell").isNotNull() & (F.col("cell") != ""), "Empty barcode")
            expect_unique(barcodes, ["cell"], "Duplicate barcode")
        named = feature_names(features).withColumnRenamed("feature", "gene")
        rows = entries.filter(F.col("x") != 0)
        rows = rows.join(named.select(F.col("ordinal").alias("i"), "gene"), "i")
        rows = rows.join(barcodes.select(F.col("ordinal").alias("j"), "cell"), "j")
        counts = rows.groupBy("gene", "cell").agg(F.sum("x").cast("bigint").alias("count"))
        data = cls(counts, named, barcodes.withColumn("sample_id", F.col("cell")))
        data = data.filter_sparse(min_cells=min_cells, min_features=min_features)
        return data.with_cell_metadata(metadata) if metadata is not None else data

    def filter_sparse(self, min_cells: int = 0, min_features: int = 0) -> CellDataset:
        """Drop cells with few detected genes, then genes detected in few of the cells left."""
        counts, features, cells = self.counts, self.features, self.cells
        if min_features > 0:
            kept = counts.groupBy("cell").count().filter(F.col("count") >= min_features).select("cell")
            counts, cells = counts.join(kept, "cell", "left_semi"), cells.join(kept, "cell", "left_semi")
        if min_cells > 0:
            kept = counts.groupBy("gene").count().filter(F.col("count") >= min_cells).select("gene")
            counts, features = counts.join(kept, "gene", "left_semi"), features.join(kept, "gene", "left_semi")
        return replace(self, counts=counts, features=features, cells=cells)

    def with_cell_metadata(self, metadata: DataFrame, key: str = "sample", check: bool = True) -> CellDataset:
        """Attach metadata columns; every cell must be covered and no column may exist already."""
        extra = [c for c in metadata.columns if c != key]
        clash = [c for c in extra if c in self.cells.columns]
        require(not clash, f"Metadata columns conflict with existing ones: {clash}")
        renamed = metadata.withColumnRenamed(key, "cell")
        if check:
            expect(renamed.select("cell"), F.col("cell").isNotNull() & (F.col("cell") != ""), "Empty sample id")
            expect_unique(renamed, ["cell"], "Duplicate sample id")
            expect_references(self.cells, renamed, ["cell"], "Metadata is missing samples")
        return replace(self, cells=self.cells.join(renamed, "cell", "left"))

    def select_cells(self, condition) -> CellDataset:
        kept = self.cells.filter(condition)
        return replace(self, counts=self.counts.join(kept.select("cell"), "cell", "left_semi"), cells=kept)

    def collapse(self, name: str = "gene_name") -> CellDataset:
        """The same dataset keyed by a feature column, equal names summed."""
        counts = collapse_features(self.counts, self.features, "gene", name, self.parts)
        valid = self.features.filter(F.col(name).isNotNull() & (F.col(name) != ""))
        return replace(self, counts=counts, features=valid.select(F.col(name).alias("gene")).distinct())

    def check_counts(self) -> CellDataset:
        """No retained cell may be empty."""
        full = self.counts.groupBy("cell").agg(F.sum("count").alias("total")).filter("total > 0")
        expect_references(self.cells, full, ["cell"], "Cells without any count")
        return self

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Store as Parquet tables under one folder."""
        self.counts.write.mode(mode).parquet(f"{path}/counts")
        self.features.write.mode(mode).parquet(f"{path}/features")
        self.cells.write.mode(mode).parquet(f"{path}/cells")
        if self.provenance is not None:
            self.provenance.write.mode(mode).parquet(f"{path}/provenance")

    @classmethod
    def read(cls, spark, path: str) -> CellDataset:
        tables = (spark.read.parquet(f"{path}/{part}") for part in ("counts", "features", "cells"))
        return cls(*tables)


def merge_datasets(datasets: dict[str, CellDataset], groups: dict[str, str]) -> CellDataset:
    """Join datasets in gene space; cells become ``dataset_cell`` and keep their ``original_sample``."""
    counts, features, cells = [], [], []
    for dataset, data in datasets.items():
        label = F.concat_ws("_", F.lit(dataset), F.col("cell"))
        counts.append(data.counts.select("gene", label.alias("cell"), "count"))
        features.append(data.features.select("gene"))
        cells.append(
            data.cells.select(
                label.alias("cell"),
                F.col("cell").alias("original_sample"),
                F.lit(dataset).alias("dataset"),
                F.lit(groups[dataset]).alias("group"),
            )
        )

    def stack(frames):
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    return CellDataset(stack(counts), stack(features).distinct(), stack(cells))


def attach_candidates(data: CellDataset, candidates: DataFrame, group: str, check: bool = True) -> CellDataset:
    """Add ``fusion_candidate`` by original sample: required for cells of ``group``, else 0."""
    if check:
        target = data.cells.filter(F.col("group") == group).select(F.col("original_sample").alias("sample"))
        expect_references(target, candidates, ["sample"], "Fusion candidates are missing samples")
    lookup = candidates.select(F.col("sample").alias("original_sample"), "candidate")
    cells = data.cells.join(lookup, "original_sample", "left").withColumn(
        "fusion_candidate", F.coalesce("candidate", F.lit(0))
    )
    return replace(data, cells=cells.drop("candidate"))
