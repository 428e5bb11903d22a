"""Datasets stored in buckets, so that work by cell and work by gene need no shuffle.

The counts are kept twice, in buckets of cells and in buckets of genes, each sorted; cells and features have the same buckets as the
counts they belong to. Normalising, selecting groups of cells and moments of genes then join and add up within buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.contracts import require
from seqlattice.operators.counts import CellDataset, cell_totals
from seqlattice.operators.embedding import gene_moments
from seqlattice.operators.markers import log_normalize

# Counts that one bucket is meant to hold.
BUCKET_ROWS = 4_000_000
_PARTS = {"counts_by_cell": ("cell", "gene"), "counts_by_gene": ("gene", "cell"), "cells": ("cell",), "features": ("gene",)}


def _register(spark: SparkSession, part: str, path: str, schema: str, buckets: int) -> DataFrame:
    """The bucketed files of ``path`` as a table of this session."""
    name = f"{part}_{uuid.uuid4().hex}"
    key = _PARTS[part]
    order = ", ".join(f"`{k}`" for k in key)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key[0]}`) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
    return spark.table(name)


@dataclass(frozen=True)
class StoredDataset:
    """A dataset whose tables lie in ``buckets`` buckets of cells or genes."""

    by_cell: DataFrame
    by_gene: DataFrame
    features: DataFrame
    cells: DataFrame
    buckets: int

    @property
    def data(self) -> CellDataset:
        """The dataset for operators that go by cell."""
        return CellDataset(self.by_cell, self.features, self.cells)

    def select_cells(self, condition: Column | str) -> StoredDataset:
        """The cells that meet a condition on their columns; counts by gene are filtered by a join on the cell."""
        kept = self.cells.filter(condition)
        some = kept.select("cell")
        return replace(self, cells=kept, by_cell=self.by_cell.join(some.hint("merge"), "cell", "left_semi"), by_gene=self.by_gene.join(some, "cell", "left_semi"))

    def normalized(self) -> DataFrame:
        """Counts with ``scaled`` and ``value`` of each cell; totals are added up in the buckets and not written."""
        return log_normalize(self.by_cell, cell_totals(self.by_cell).hint("merge"))

    def moments(self) -> DataFrame:
        """Mean and variance of each gene over all cells of the dataset."""
        return gene_moments(self.by_gene, self.features.hint("merge"), self.cells.count())


def write_dataset(data: CellDataset, path: str, buckets: int | None = None) -> StoredDataset:
    """Write a dataset into a new folder; the number of buckets follows from that of the counts."""
    spark = data.counts.sparkSession
    if buckets is None:
        buckets = max(1, -(-data.counts.count() // BUCKET_ROWS))
    require(1 <= buckets <= 100_000, "The number of buckets must lie between 1 and 100,000")
    counts = data.counts.select("gene", "cell", "count")
    tables = {"counts_by_cell": counts, "counts_by_gene": counts, "cells": data.cells, "features": data.features}
    for part, table in tables.items():
        key = _PARTS[part]
        if part == "counts_by_gene":
            # Those just written, so that the counts are made once.
            table = spark.read.schema(table.schema).parquet(f"{path}/counts_by_cell")
        # A task writes whole buckets, so there is one file for each.
        dealt = table.repartition(buckets, key[0]).sortWithinPartitions(*key)
        name = f"new_{part}_{uuid.uuid4().hex}"
        dealt.write.format("parquet").option("path", f"{path}/{part}").bucketBy(buckets, key[0]).sortBy(*key).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
    if data.provenance is not None:
        data.provenance.write.parquet(f"{path}/provenance")
    schemas = [(part, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields), buckets) for part, table in tables.items()]
    spark.createDataFrame(schemas, "part string, columns string, buckets int").coalesce(1).write.parquet(f"{path}/layout")
    return read_dataset(spark, path)


def read_dataset(spark: SparkSession, path: str) -> StoredDataset:
    """A dataset that ``write_dataset`` stored, also in another session."""
    layout = {r["part"]: (r["columns"], r["buckets"]) for r in spark.read.parquet(f"{path}/layout").collect()}
    require(set(layout) == set(_PARTS), f"No stored dataset in {path}")
    tables = {part: _register(spark, part, path, *layout[part]) for part in _PARTS}
    return StoredDataset(tables["counts_by_cell"], tables["counts_by_gene"], tables["features"], tables["cells"], layout["cells"][1])
