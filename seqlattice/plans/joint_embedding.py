"""Joint embedding of several datasets, and of one group on its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from seqlattice.contracts import expect_counts
from seqlattice.operators.counts import CellDataset, attach_candidates, merge_datasets
from seqlattice.operators.embedding import coordinates, embed, embed_group
from seqlattice.session import materialize
from seqlattice.sources.tables import read_10x
from seqlattice.sources.writers import write_coordinates


@dataclass(frozen=True)
class Embeddings:
    joint: DataFrame
    joint_graph: DataFrame
    group: DataFrame
    group_graph: DataFrame

    def write(self, path: str) -> None:
        write_coordinates(self.joint, f"{path}/joint_coordinates")
        write_coordinates(self.group, f"{path}/group_coordinates")
        self.joint_graph.write.parquet(f"{path}/joint_graph")
        self.group_graph.write.parquet(f"{path}/group_graph")


def load_datasets(spark: SparkSession, manifest: DataFrame) -> tuple[dict[str, CellDataset], dict[str, str]]:
    """Datasets of a manifest in gene-symbol space; a few rows, one per dataset."""
    data, groups = {}, {}
    for row in manifest.orderBy("ordinal").collect():
        if row["format"] == "10x_dir":
            loaded = CellDataset.from_matrix(*read_10x(spark, row["path"])).collapse("gene_name")
        else:
            loaded = CellDataset.read(spark, row["path"])
            expect_counts(loaded.counts)
            if row["feature_column"] and row["feature_column"] != ".":
                loaded = loaded.collapse(row["feature_column"])
        data[row["dataset"]], groups[row["dataset"]] = loaded, row["group"]
    return data, groups


def run(
    datasets: dict[str, CellDataset],
    groups: dict[str, str],
    candidates: DataFrame,
    group: str,
    joint_features: int = 3000,
    group_features: int = 2000,
    components: int = 30,
    joint_dims: int = 30,
    group_dims: int = 15,
) -> Embeddings:
    merged = attach_candidates(merge_datasets(datasets, groups), candidates, group)
    merged = CellDataset(materialize(merged.counts), materialize(merged.features), materialize(merged.cells))
    pcs, graph = embed(merged, joint_features, components, joint_dims)
    own_pcs, own_graph = embed_group(
        merged, group, n_features=group_features, components=components, dims=group_dims
    )
    return Embeddings(coordinates(merged, pcs), graph, coordinates(merged, own_pcs), own_graph)
