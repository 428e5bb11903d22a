"""Counts are added up in as many tasks as their number asks for."""

from dataclasses import replace

from seqlattice.operators.counts import CellDataset
from workload import tables as W


def test_parts_of_a_dataset(spark, monkeypatch):
    counts = spark.createDataFrame([(g % 50, g % 7, 1 + g % 3) for g in range(900)], "gene long, cell long, count long")
    names = spark.createDataFrame([(g, f"n{g % 10}") for g in range(50)], "gene long, gene_name string")
    data = CellDataset.from_counts(counts, names, parts=13)
    assert data.counts.rdd.getNumPartitions() == 13
    one = replace(CellDataset.from_counts(counts, names)).collapse("gene_name")
    two = data.collapse("gene_name")
    assert two.counts.rdd.getNumPartitions() == 13
    assert sorted(map(tuple, one.counts.collect())) == sorted(map(tuple, two.counts.collect()))
    monkeypatch.setattr(W, "GROUP_ROWS", 250)
    folder = "/root/testdata/sf0.001"
    lines = W.table(spark, folder, "lineitem").count()
    assert W.part_dataset(spark, folder).counts.rdd.getNumPartitions() == -(-lines // 250)
